"""Substring dedup by super-k-mer partitioning.

Words are the letters of the alphabet. A window is 20 consecutive words; its minimiser is
the least hashed 8-word gram in it (leftmost of equals). Consecutive windows with the same
minimiser position form a super-k-mer: one packed string of some 26 words stands for 7
windows. Equal windows have equal minimisers, so they meet in one bucket.

1. Count the minimisers of all super-k-mers. Those seen once can't hold a repeated
   window; a bit filter of bounded size lets the second scan leave their strings out.
2. Send the packed strings of the others to their buckets. A task sends each string once:
   further occurrences in the task are repeats by themselves and go out as intervals only,
   so a passage in a third of all documents costs one string per task.
   Minimisers with very many occurrences (a common line in differing surroundings) are
   split into single windows, each with a bucket of its own; a second bit filter names them, so
   no bucket grows with the table, and what it names by chance is split for nothing.
3. A bucket, read in key order, sorts its windows with their places: the first of a run of
   equal windows stays, the others become intervals of removed words.
4. Intervals meet their document by one join; nothing else moves the texts.

A document is told apart by id and hash of its text, so intervals never meet another row's text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_rows, stage
from .words import WordHashes, grams, id_text, public_id, slices

WINDOW, GRAM = 20, 8
#: Bits of the filter of repeated minimisers: 8 for each, between these powers of two (16 MB at most).
FILTER_BITS = (15, 27)
#: A minimiser with more occurrences than this is split by window.
HOT = 2000
#: Packed strings a task remembers, in bytes, before it starts afresh (results don't depend on it).
SEEN_BYTES = 64 << 20

RUNS = pa.schema([("key", pa.int64()), ("packed", pa.binary()), ("doc", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
GONE = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
RUN_COLUMNS = "key long, packed binary, doc long, h long, start int, n int"
GONE_COLUMNS = "doc long, h long, start int, n int"


def super_kmers(h: np.ndarray, lengths: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of each super-k-mer; ``h`` holds the word hashes of documents of ``lengths`` words one after another."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, np.zeros(0, np.uint64)
    v = grams(h, gram)
    at = np.lib.stride_tricks.sliding_window_view(v, window - gram + 1).argmin(axis=1) + np.arange(len(h) - window + 1)
    ends = np.repeat(np.cumsum(lengths), lengths)[: len(at)]
    ok = np.arange(len(at)) + window <= ends
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(np.cumsum(ok)[first] - 1, ok.sum()))
    return first, count, v[at[first]]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for part in slices(batch):
            words = [t.split() for t in part.column("text").to_pylist()]
            flat = [w for x in words for w in x]
            keys, n = np.unique(super_kmers(hashes.of(flat), np.fromiter(map(len, words), np.int64, len(words)))[2].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])


def bit_filter(keys: DataFrame, size: int, each: int) -> tuple[bytes, int]:
    """A bit per slot of keys(key), ``each`` bits for each of ``size`` keys within FILTER_BITS, and the number of bits' power.

    It comes to the driver in rows of 4 KB; its size is bounded whatever the input.
    """
    power = max(FILTER_BITS[0], min(FILTER_BITS[1], (each * max(1, size)).bit_length()))
    bits = np.zeros(1 << (power - 3), np.uint8)
    for b, x in bit_rows(keys, "key", power).toLocalIterator():
        bits[b * 4096 : (b + 1) * 4096] = np.frombuffer(bytes(x), np.uint8)
    return bits.tobytes(), power


def is_set(bits: np.ndarray, power: int, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64((1 << power) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Sender:
    """What one task sends: RUNS of rows that come in order of (doc, h); rows without ``packed`` are intervals of removed words."""

    def __init__(self) -> None:
        self.seen: dict[bytes, tuple[int, int, int]] = {}  # packed string: its first place
        self.held = 0
        self.out: tuple[list, ...] = ([], [], [], [], [], [])
        self.last: tuple | None = None  # an interval of removed words that may still grow: doc, h, start, end

    def put(self, *row) -> None:
        for c, x in zip(self.out, row, strict=True):
            c.append(x)

    def gone(self, doc: int, h: int, a: int, b: int) -> None:
        last = self.last
        if last and last[:2] == (doc, h) and a <= last[3]:
            self.last = (doc, h, last[2], max(b, last[3]))
            return
        self.end_interval()
        self.last = (doc, h, a, b)

    def end_interval(self) -> None:
        if self.last:
            doc, h, a, b = self.last
            self.put(xxhash.xxh64_intdigest(b"%d %d %d" % (doc, h, a)) - (1 << 63), None, doc, h, a, b - a)
        self.last = None

    def offer(self, key: int | None, words: list[bytes], at: int, doc: int, h: int, a: int, n: int) -> None:
        """``n`` windows at ``words[at:]``, which begin at word ``a`` of their document. Without a key the string gives it."""
        packed = b" ".join(words[at : at + n + WINDOW - 1])
        was, here = self.seen.get(packed), (doc, h, a)
        if was is None or was > here:
            self.seen[packed] = here
            self.held += len(packed) + 150
            self.put(xxhash.xxh64_intdigest(packed) - (1 << 63) if key is None else key, packed, doc, h, a, n)
        elif was < here:
            self.gone(doc, h, a, a + n + WINDOW - 1)

    def batch(self) -> pa.RecordBatch:
        self.end_interval()
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.out, RUNS, strict=True)], schema=RUNS)
        self.out = ([], [], [], [], [], [])
        if self.held > SEEN_BYTES:
            self.seen, self.held = {}, 0
        return made


def sent(repeated, repeated_power: int, hot, hot_power: int):
    """Pass 2, over rows in order of (doc, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, often = np.frombuffer(repeated.value, np.uint8), np.frombuffer(hot.value, np.uint8)
        hashes, sender = WordHashes(), Sender()
        for batch in batches:
            for part in slices(batch):
                words = [t.split() for t in part.column("text").to_pylist()]
                docs, own = part.column("doc").to_pylist(), part.column("h").to_pylist()
                flat = [w for x in words for w in x]
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                begin = np.cumsum(lengths) - lengths
                first, count, key = super_kmers(hashes.of(flat), lengths)
                keep = is_set(twice, repeated_power, key)
                first, count, key = first[keep], count[keep], key[keep]
                owner = np.searchsorted(begin, first, "right") - 1
                split = is_set(often, hot_power, key)
                for at, n, k, o, s in zip(first.tolist(), count.tolist(), key.view(np.int64).tolist(), owner.tolist(), split.tolist(), strict=True):
                    a = at - int(begin[o])
                    if s:
                        for j in range(n):
                            sender.offer(None, flat, at + j, docs[o], own[o], a + j, 1)
                    else:
                        sender.offer(k, flat, at, docs[o], own[o], a, n)
                yield sender.batch()

    return run


def bucket(rows: list[tuple[bytes, int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Removed intervals (doc, h, start, words) of one bucket's super-k-mers (packed, doc, h, start, windows)."""
    rows.sort()
    own = []
    for i, r in enumerate(rows):
        if i and r[0] == rows[i - 1][0]:
            if r[1:4] != own[-1][1:4]:  # a row that is repeated with its id is one and the same place
                yield r[1], r[2], r[3], r[4] + WINDOW - 1
        else:
            own.append(r)
    if len(own) < 2:
        return
    windows = []
    for packed, doc, h, start, n in own:
        if n == 1:
            windows.append((packed, doc, h, start))
            continue
        cut = [0, *(i + 1 for i, c in enumerate(packed) if c == 32), len(packed) + 1]
        windows += [(packed[cut[j] : cut[j + WINDOW] - 1], doc, h, start + j) for j in range(n)]
    windows.sort()
    best = None
    for w in windows:
        if best is None or w[0] != best[0]:
            best = w
        elif w[1:] > best[1:]:
            yield *w[1:], WINDOW


def intervals(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), GONE, strict=True)], schema=GONE)


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of key; one bucket is held at a time."""
    key, rows = None, []
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for k, packed, doc, h, start, n in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            if packed is None:
                out.append((doc, h, start, n))
                continue
            if k != key:
                if len(rows) > 1:
                    out += bucket(rows)
                key, rows = k, []
            rows.append((packed, doc, h, start, n))
        if out:
            yield intervals(out)
    if len(rows) > 1 and (out := list(bucket(rows))):
        yield intervals(out)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, h, start, n): intervals of words covered by windows that also start earlier."""
    sc = docs.sparkSession.sparkContext
    source = documents(docs, id_col, text_col)
    counts = stage(source.select("text").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "minimisers")
    size, many = counts.agg(F.count("*"), F.count_if(F.col("n") > HOT)).first()
    twice, power = bit_filter(counts, size, 8)
    often, hot_power = bit_filter(counts.where(F.col("n") > HOT), many, 16)
    run = sent(sc.broadcast(twice), power, sc.broadcast(often), hot_power)
    rows = source.sortWithinPartitions("doc", "h").mapInArrow(run, RUN_COLUMNS)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(buckets, GONE_COLUMNS)


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, h): ``id_text`` and the hash that tells rows of one id apart."""
    return id_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for part in slices(batch):
            for doc, text, gone in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "gone")), strict=True):
                words = text.split()
                if gone:
                    stays = np.ones(len(words), bool)
                    for x in gone:
                        stays[x["start"] : x["start"] + x["n"]] = False
                    kept = [words[i] for i in np.flatnonzero(stays)]
                else:
                    kept = words
                text = b" ".join(kept)
                for c, x in zip(out, (doc, len(words), len(words) - len(kept), text), strict=True):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["doc", "n_words", "n_removed", "kept"])


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], sha], names=["doc", "n_words", "n_removed", "kept_sha256"])


def with_intervals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    gone = repeats(docs, id_col, text_col).groupBy("doc", "h").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    return documents(docs, id_col, text_col).join(gone, ["doc", "h"], "left").select("doc", "text", "gone")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, text (kept words joined by one space).

    Null texts have no words; texts under 20 words lose none; very long ones are worked through by slices of whole texts,
    so one text must fit into a task. A null id counts as smaller than all others. Every row is a document of its own;
    those of one id, or without one, are ordered by the hash of their text. Only rows that repeat both id and text
    are one document listed twice: they lose the same words. An empty table gives an empty result; other columns are not read.
    """
    out = with_intervals(docs, id_col, text_col).mapInArrow(trimmed, "doc long, n_words long, n_removed long, kept binary")
    return out.select(public_id(F.col("doc")).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("text"))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = with_intervals(docs, "doc_id", "text").mapInArrow(digested, "doc long, n_words long, n_removed long, kept_sha256 string")
    return out.select(public_id(F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d WHERE len(w) > 0),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS x FROM p WHERE i + 20 <= len(w)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE k > 1),
k AS (SELECT p.doc_id, list(w[p.i + 1] ORDER BY p.i) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(len(kept), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
