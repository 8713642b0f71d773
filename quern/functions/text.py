"""Text scalars and tokenizers; inside the JVM but for word counts and the longest match over many terms."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage

#: Runs of digits and ASCII punctuation become one space; words are parted by these blanks.
NOISE = r"[0-9\p{Punct}]+"
BLANK = r"[ \t\n\f\r]+"
#: A vocabulary up to this many terms is compiled into one pattern.
PATTERN_TERMS = 200
#: A larger one of up to this many bytes is sent to the texts (some ten times that in a Python worker); beyond, it is joined.
SENT_BYTES = 32 << 20
#: Sent terms are looked up by lengths that go with their first letters.
HEAD = 4


def _accents() -> tuple[str, str, str]:
    """Letters of U+00C0..U+024F that decompose to one base letter, their bases, and combining marks to delete."""
    source, target = [], []
    for c in map(chr, range(0xC0, 0x250)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            source.append(c)
            target.append(base)
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(source), "".join(target), marks


_SOURCE, _TARGET, _MARKS = _accents()


def strip_accents(col: Column) -> Column:
    """Latin letters without their accents; letters that do not decompose stay."""
    return F.translate(col, _SOURCE + _MARKS, _TARGET)


def folded(col: Column) -> Column:
    return F.lower(strip_accents(col.cast("string")))


def clean(col: Column) -> Column:
    return F.regexp_replace(folded(col), NOISE, " ")


def regex_tokens(col: Column) -> Column:
    """Words as an array; a text that begins or ends in noise has an empty first or last entry."""
    return F.split(clean(col), BLANK)


def word_counts(df: DataFrame, words: Column, out: str = "terms") -> DataFrame:
    """``df`` with ``out`` as its last column, the distinct ``words`` of each row with their number, [(term, tf)]: no row leaves its task."""
    others = [c for c in df.columns if c != out]
    rows = df.select(*others, F.coalesce(words, F.array().cast("array<string>")).alias(out))
    schema = df.select(*others, F.array(F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("tf"))).alias(out)).schema
    return rows.mapInArrow(_counted, schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, lists of words, as lists of distinct words with their numbers."""
    for batch in batches:
        words = batch.column(batch.num_columns - 1)
        codes = words.flatten().dictionary_encode()
        size = max(len(codes.dictionary), 1)
        row = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
        keys, tf = np.unique(row * size + codes.indices.to_numpy(), return_counts=True)
        pairs = pa.StructArray.from_arrays([codes.dictionary.take(pa.array(keys % size)), pa.array(tf, pa.int64())], names=["term", "tf"])
        starts = np.searchsorted(keys // size, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs)], names=batch.schema.names)


def trie_pattern(terms: list[str]) -> str:
    """A pattern whose leftmost match is the longest term at that place."""
    root: dict = {}
    for t in terms:
        node = root
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node: dict) -> str:
        chain = ""
        while len(node) == 1 and "" not in node:  # no branch: plain text, no recursion
            c, node = next(iter(node.items()))
            chain += re.escape(c)
        rest = [re.escape(c) + build(n) for c, n in sorted(node.items()) if c]
        if not rest:
            return chain
        body = "(?:" + "|".join(rest) + ")"
        return chain + (body + "?" if "" in node else body)

    return build(root) if root else r"(?!)"


def longest_match_tokens(col: Column, pattern: str) -> Column:
    """Greedy longest matches from left to right; characters between matches are skipped. ``col`` is folded already."""
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def longest_match(df: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame) -> DataFrame:
    """(id, tokens) by greedy longest match over ``vocabulary(term)``.

    Small vocabularies become one pattern. Larger ones go to the texts, which stay where they are. Only those beyond ``SENT_BYTES``
    are joined: a text's substrings of every length that a term has meet the terms, and a walk over the matches takes them greedily.
    Only matches are gathered by text, never substrings.
    """
    terms = stage(vocabulary.select("term").where("term <> ''").distinct(), "terms")
    n, held = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if n <= PATTERN_TERMS:
        return df.select(F.col(id_col), longest_match_tokens(F.col(text_col), trie_pattern([r.term for r in terms.collect()])).alias("tokens"))
    if held <= SENT_BYTES:
        sent = df.sparkSession.sparkContext.broadcast(terms.toArrow().column("term").combine_chunks())
        rows = df.select(F.col(id_col), F.col(text_col).alias("tokens"))
        schema = rows.select(id_col, F.array("tokens").alias("tokens")).schema
        return rows.mapInArrow(_matched_in(sent), schema)
    lengths = sorted(r[0] for r in terms.select(F.length("term")).distinct().collect())
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    at = None
    for n in lengths:  # all substrings of n letters in one pass over the text
        grams = F.regexp_extract_all("__text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        own = rows.select("__id", F.posexplode(grams).alias("i", "term")).join(terms.where(F.length("term") == n), "term")
        own = own.select("__id", "i", F.lit(n).alias("n"), "term")  # by length, so of a place the longest comes last
        at = own if at is None else at.unionByName(own)
    lists = at.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("i", "n", "term"))).alias("m"))
    schema = lists.select("__id", F.array().cast("array<string>").alias("tokens")).schema
    got = lists.mapInArrow(_greedy, schema)
    out = df.select(F.col(id_col)).join(got, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    return out.select(id_col, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


class Terms:
    """Greedy longest matches over a set of terms: at a place only lengths are tried that a term with these first letters has."""

    def __init__(self, terms: list[str]):
        self.terms = set(terms)
        lengths: dict[str, set[int]] = {}
        for t in self.terms:
            if len(t) >= HEAD:
                lengths.setdefault(t[:HEAD], set()).add(len(t))
        kept: dict[tuple, tuple] = {}  # many first letters have the same lengths
        self.lengths = {h: kept.setdefault(k, k) for h, n in lengths.items() for k in [tuple(sorted(n, reverse=True))]}
        self.short = tuple(sorted({len(t) for t in self.terms if len(t) < HEAD}, reverse=True))

    def tokens(self, s: str) -> list[str]:
        out, at, end = [], 0, len(s)
        terms, lengths, short = self.terms, self.lengths, self.short
        while at < end:
            for n in lengths.get(s[at : at + HEAD], ()):
                if (t := s[at : at + n]) in terms:
                    break
            else:
                for n in short:
                    if (t := s[at : at + n]) in terms:
                        break
                else:
                    at += 1
                    continue
            out.append(t)
            at += len(t)
        return out


#: The terms that this Python worker used last, by the name of their broadcast.
_last_terms: dict[str, Terms] = {}


def _matched_in(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, tokens) of (id, text), for terms sent to all workers."""
    key = uuid.uuid4().hex

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _last_terms:
            _last_terms.clear()
            _last_terms[key] = Terms(sent.value.to_pylist())
        find = _last_terms[key].tokens
        for batch in batches:
            out = [find(s) if s else [] for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=batch.schema.names)

    return match


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens) of (id, matches in order of place and length): the longest at a place, then on behind it."""
    for batch in batches:
        out = []
        for m in batch.column("m").to_pylist():
            tokens, last, end = [], -1, 0
            for x in m:
                if x["i"] == last:
                    tokens[-1] = x["term"]
                elif x["i"] >= end:
                    tokens.append(x["term"])
                    last = x["i"]
                else:
                    continue
                end = last + len(x["term"].encode("utf-16-le")) // 2  # the pattern engine counts places so
            out.append(tokens)
        yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(out, pa.list_(pa.string()))], names=["__id", "tokens"])


def ln(col: Column) -> Column:
    """Natural logarithm with the limits that a columnar SQL engine gives: minus infinity at 0, NaN below."""
    return F.when(col == 0, F.lit(float("-inf"))).when(col < 0, F.lit(float("nan"))).otherwise(F.log(col))
