"""Tokenizers, stop words, stemmers, exact probabilities."""

import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import prob, stemmers, stopwords, text


def greedy(s, vocabulary):
    out, i = [], 0
    while i < len(s):
        best = max((v for v in vocabulary if v and s.startswith(v, i)), key=len, default=None)
        if best is None:
            i += 1
        else:
            out.append(best)
            i += len(best)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc .+", max_size=5), max_size=12), st.text("abc .+", max_size=30))
def test_trie_pattern_is_greedy_longest_match(vocabulary, s):
    import re

    assert re.findall(text.trie_pattern([v for v in vocabulary if v]), s) == greedy(s, vocabulary)


@pytest.mark.parametrize("most", [50_000, 3])
def test_longest_match(spark, monkeypatch, most):
    monkeypatch.setattr(text, "PATTERN_TERMS", most)  # 3: the vocabulary is joined
    vocabulary = ["super", "sonic", "supersonic flow", "flow", "so", "on", "a.b", "x"]
    rows = [(1, "supersonic flow"), (2, "supersonic jet"), (3, ""), (4, "zzz"), (5, "xxa.b a+b"), (6, None), (7, "soso supersonic flo")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r.tokens for r in text.longest_match(df, "id", "t", spark.createDataFrame([(v,) for v in vocabulary], "term string")).collect()}
    assert {k: v or [] for k, v in got.items()} == {i: greedy(t or "", vocabulary) for i, t in rows}


def test_regex_tokens(spark):
    rows = [("Crème-brûlée, 2nd!",), ("word, word",), ("",), ("æøß don't",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "s string").select(text.regex_tokens(F.col("s")).alias("t")).collect()]
    assert got == [["creme", "brulee", "nd", ""], ["word", "word"], [""], ["æøß", "don", "t"], None]


def test_accents_follow_unicode(spark):
    letters = "".join(map(chr, range(0xC0, 0x250)))
    got = spark.createDataFrame([(letters,)], "s string").select(text.strip_accents(F.col("s"))).first()[0]
    assert got == "".join(c for c in unicodedata.normalize("NFD", letters) if not unicodedata.combining(c))


def test_logarithm_limits(spark):
    got = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (None,)], "x double").select(text.ln(F.col("x"))).collect()
    assert got[0][0] == -math.inf and math.isnan(got[1][0]) and got[2][0] == 0 and got[3][0] is None


def test_stop_words(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("the, of\nand,,\n the\n")
    assert stopwords.stop_words(spark, f"file://{tmp_path}/stop.txt") == ["and", "of", "the"]
    assert stopwords.stop_words(spark, None) == stopwords.stop_words(spark, "none") == []
    assert "the" in stopwords.stop_words(spark, "english") and stopwords.stop_words(spark, {"b", "a", ""}) == ["a", "b"]


def test_porter():
    """Examples of the published description."""
    pairs = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
    conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
    relational relat conditional condit valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
    vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
    sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
    revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac
    adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
    bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()
    for w, s in zip(pairs[::2], pairs[1::2], strict=True):
        assert stemmers.porter(w) == s, w


def test_dutch():
    for w, s in [("lichaam", "licham"), ("lichamelijk", "licham"), ("opglimpten", "opglimpt"), ("opheffende", "opheff"), ("katten", "kat"), ("huizen", "huiz")]:
        assert stemmers.dutch(w) == s, w


def test_stem_terms(spark):
    df = spark.createDataFrame([("running",), (None,), ("cats",)], "term string")
    assert {r.stem for r in stemmers.stem_terms(df, "term", "porter").collect()} == {"run", None, "cat"}
    assert {r.stem for r in stemmers.stem_terms(df, "term", "none").collect()} == {"running", None, "cats"}


def test_sign_test_probability(spark):
    rows = [(a, b) for a in range(0, 40, 3) for b in range(0, 40, 4)] + [(900, 1000), (0, 0)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", prob.sign_test_p(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        n, k = r.a + r.b, min(r.a, r.b)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else None
        assert r.p is None if want is None else abs(r.p - want) < 1e-9
