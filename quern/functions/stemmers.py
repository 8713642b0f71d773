"""Porter (1980) and Snowball Dutch stemmers, from their published descriptions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _short_end(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, ends) -> str | None:
    return max((e for e in ends if w.endswith(e)), key=len, default=None)


def porter(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _shape(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short_end(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = _longest(w, table)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = _longest(w, _STEP4)
    if end:
        stem = w[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


_DUTCH_VOWELS = set("aeiouyè")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i - 1] in _DUTCH_VOWELS and w[i] not in _DUTCH_VOWELS:
                return i + 1
        return len(w)

    first = after(0)
    return max(first, 3), after(first)


def _undouble(w: str) -> str:
    return w[:-1] if w.endswith(("kk", "dd", "tt")) else w


def dutch(w: str) -> str:
    table = str.maketrans("äëïöüáéíóú", "aeiouaeiou")
    w = unicodedata.normalize("NFC", w).translate(table)
    # y at the start or after a vowel, and i between vowels, count as consonants (upper case meanwhile)
    c = list(w)
    for i, x in enumerate(c):
        before = i > 0 and c[i - 1] in _DUTCH_VOWELS
        if (x == "y" and (i == 0 or before)) or (x == "i" and before and i + 1 < len(c) and c[i + 1] in _DUTCH_VOWELS):
            c[i] = x.upper()
    w = "".join(c)
    r1, r2 = _regions(w)

    def valid_s(s: str) -> bool:
        return bool(s) and s[-1] not in _DUTCH_VOWELS and s[-1] != "j"

    def valid_en(s: str) -> bool:
        return bool(s) and s[-1] not in _DUTCH_VOWELS and not s.endswith("gem")

    end = _longest(w, ("heden", "en", "ene", "s", "se"))
    if end and len(w) - len(end) >= r1:
        stem = w[: -len(end)]
        if end == "heden":
            w = stem + "heid"
        elif end in ("en", "ene") and valid_en(stem):
            w = _undouble(stem)
        elif end in ("s", "se") and valid_s(stem):
            w = stem
    e_removed = False
    if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in _DUTCH_VOWELS:
        w, e_removed = _undouble(w[:-1]), True
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en") and len(w) - 2 >= r1 and valid_en(w[:-2]):
            w = _undouble(w[:-2])
    end = _longest(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if end and len(w) - len(end) >= r2:
        stem = w[: -len(end)]
        if end in ("end", "ing"):
            if stem.endswith("ig") and len(stem) - 2 >= r2 and not stem.endswith("eig"):
                w = stem[:-2]
            else:
                w = _undouble(stem)
        elif end == "ig":
            if not stem.endswith("e"):
                w = stem
        elif end == "lijk":
            w = stem
            if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in _DUTCH_VOWELS:
                w = _undouble(w[:-1])
        elif end == "baar" or e_removed:
            w = stem
    if len(w) >= 4 and w[-4] not in _DUTCH_VOWELS and w[-3:-1] in ("aa", "ee", "oo", "uu") and w[-1] not in _DUTCH_VOWELS and w[-1] != "I":
        w = w[:-2] + w[-1]
    return w.lower()


STEMMERS = {"none": lambda w: w, "porter": porter, "dutch": dutch}


def stem(col: Column, stemmer: str) -> Column:
    """The stem of each word; null stays null. ``none`` is the column itself."""
    if stemmer == "none":
        return col
    one = STEMMERS[stemmer]

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else one(w))

    return run(col)


def stem_terms(words: DataFrame, col: str, stemmer: str) -> DataFrame:
    """Distinct ``words`` with their ``stem``."""
    return words.withColumn("stem", stem(F.col(col), stemmer))
