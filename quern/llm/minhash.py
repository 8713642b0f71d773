"""MinHash near-dedup with sequential Bayesian verification.

1. One scan: per document the number of distinct word 5-grams, the SHA-256 of its word sequence and a signature of 140
   min-hashes. Equal sequences are one class with one representative.
2. 28 bands of 5 min-hashes. Band keys seen once are dropped by a count; the rest are buckets. Every class is first compared
   with one leader only, the least class of the buckets that it shares with most bands: 28 min-hashes at a time, and dropped
   as soon as the posterior chance of reaching the threshold (uniform prior) falls below ``miss``. Survivors are confirmed on
   their full sets (shingles interned exactly, no hashes). A group of copies is settled by that, in proportion to its size.
3. Buckets that still hold several components are worked through in cells of bounded size, which leave out the pairs within
   a bucket's largest component. Their survivors, if not of one component, form families, whose texts meet in cells of
   bounded bytes and are confirmed in the same way. Confirmed links become components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_rows, connected_components, joined_by_size, probed, stage
from .words import WordHashes, grams, id_text, mix, public_id, slices

SHINGLE, ROWS, BANDS = 5, 5, 28
HASHES = ROWS * BANDS
BATCH = 28
MISS = 1e-5
CELL_MEMBERS, CELL_BYTES = 1024, 2 << 20
_RNG = np.random.default_rng(20240501)
FACTORS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bits of the filter that picks texts to fetch: 16 each, between these powers of two (16 MB at most).
FILTER_BITS = (15, 27)

SIGNED = "doc long, h long, bytes long, n long, sha binary, sig binary"


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """For n compared min-hashes the least number of matches with P(similarity >= threshold) >= miss under a uniform prior."""
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def shingle_hashes(words: list[bytes], h: np.ndarray) -> np.ndarray:
    """Distinct hashes of a document's 5-grams; of the whole sequence when it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return grams(h, len(words)) ^ np.uint64(len(words))
    return np.unique(grams(h, SHINGLE))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[documents, HASHES] 16-bit min-hashes; zero rows for empty sets."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    for k, f in enumerate(FACTORS):
        out[full, k] = (mix(np.minimum.reduceat(flat * f, starts)) >> np.uint64(48)).astype(np.uint16)
    return out


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for part in slices(batch):
            words = [t.lower().split() for t in part.column("text").to_pylist()]
            h = hashes.of([w for x in words for w in x])
            ends = np.cumsum([len(x) for x in words])
            sets = [shingle_hashes(w, h[e - len(w) : e]) for w, e in zip(words, ends, strict=True)]
            sig = signatures(sets)
            sha = [hashlib.sha256(b" ".join(w)).digest() for w in words]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("h"), pc.binary_length(part.column("text")).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(sha, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())],
                names=["doc", "h", "bytes", "n", "sha", "sig"],
            )


class Forest:
    """Union-find over 0..n-1 with labels as an array."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def tie(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def survivors(sig: np.ndarray, least: dict[int, int], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (i, j, matches) of pairs from left x right that no batch of min-hashes has ruled out; i < j where both are the same rows."""
    same = left is right
    other = np.ascontiguousarray(sig[right, :BATCH])
    for a in range(0, len(left), 32):
        rows = left[a : a + 32]
        m = (sig[rows, None, :BATCH] == other[None]).sum(axis=2, dtype=np.int16)
        i, j = np.nonzero(m >= least[BATCH])
        m = m[i, j]
        i, j = rows[i], right[j]
        if same:
            ok = i < j
            i, j, m = i[ok], j[ok], m[ok]
        for n in range(2 * BATCH, HASHES + 1, BATCH):
            m = m + (sig[i, n - BATCH : n] == sig[j, n - BATCH : n]).sum(axis=1, dtype=np.int16)
            ok = m >= least[n]
            i, j, m = i[ok], j[ok], m[ok]
        if len(i):
            yield i, j, m


def cells(df: DataFrame, key: str, blocks) -> DataFrame:
    """Deal the members of each key to ``blocks`` blocks and pair the blocks: rows get key, (lo, hi) and their block."""
    block = F.pmod(F.xxhash64("member"), F.col("blocks"))
    df = df.withColumn("blocks", blocks).withColumn("block", block)
    df = df.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return df.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with")).withColumn("cell", F.xxhash64(key, "lo", "hi")).drop("with", "blocks")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """The rows of one value of ``keys`` after another, as lists by column; rows come in order."""
    own, was = None, None
    for batch in batches:
        x = batch.to_pydict()
        ks = list(zip(*(x[k] for k in keys), strict=True))
        start = 0
        for i in range(1, len(ks) + 1):
            if i == len(ks) or ks[i] != ks[start]:
                part = {c: v[start:i] for c, v in x.items()}
                if ks[start] == was:
                    for c in own:
                        own[c] += part[c]
                else:
                    if own:
                        yield own
                    own, was = part, ks[start]
                start = i
    if own:
        yield own


def links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def sides(g: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two blocks of a cell: one and the same array within a block."""
    if g["lo"][0] == g["hi"][0]:
        own = np.arange(len(g["block"]))
        return own, own
    block = np.array(g["block"])
    return np.flatnonzero(block == g["lo"][0]), np.flatnonzero(block == g["hi"][0])


def joint(left: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(left.to_pylist()), np.uint16).reshape(len(left), HASHES)


def pruned(least: dict[int, int]) -> Callable:
    """Of pairs with both signatures those that no batch of min-hashes rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = joint(batch.column("sig")), joint(batch.column("leader_sig"))
                alive, m = np.arange(len(x)), np.zeros(len(x), np.int64)
                for n in range(BATCH, HASHES + 1, BATCH):
                    m = m + (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
                    ok = m >= least[n]
                    alive, m = alive[ok], m[ok]
                yield batch.take(pa.array(alive)).select(["member", "leader"])

    return run


def families(least: dict[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["cell", "key", "lo", "hi"]):
            left, right = sides(g)
            sig, comp = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(g["sig"]), HASHES), g["comp"]
            f, a, b = Forest(len(sig)), [], []
            for i, j, _ in survivors(sig, least, left, right):
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    if comp[p] != comp[q] and f.tie(p, q):
                        a.append(g["member"][p])
                        b.append(g["member"][q])
            if a:
                yield links(a, b)

    return run


def exact_sets(docs: list[list[bytes]]) -> list[np.ndarray]:
    """Shingle sets as sorted numbers, the same number for the same words only: words, then pairs, triples ... are interned."""
    intern: dict[bytes, int] = {}
    ids = [np.array([intern.setdefault(w, len(intern)) for w in x], np.int64) for x in docs]
    flat, n = np.concatenate(ids), max(1, len(intern))
    code = flat
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
    ends = np.cumsum([len(x) for x in ids])
    base = 0
    for size in range(1, SHINGLE + 1):
        if size > 1:
            code = np.unique(code[:-1] * n + flat[size - 1 :], return_inverse=True)[1] if len(code) > 1 else code[:0]
        for d, e in enumerate(ends):
            have = len(ids[d])
            if have == size < SHINGLE or have >= size == SHINGLE:
                out[d] = np.unique(code[e - have : e - size + 1]) + base
        base += len(flat) + 1
    return out


def starred(threshold: tuple[int, int]) -> Callable:
    """Links of the members of a cell with their leader, confirmed on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["leader", "part"]):
            text = dict(zip(g["member"], g["text"], strict=True))  # a repeated row comes twice
            members = list(text)
            sets = exact_sets([t.lower().split() for t in text.values()])
            lead = members.index(g["leader"][0])
            mark = np.zeros(1 + max(int(s[-1]) for s in sets if len(s)), bool)
            mark[sets[lead]] = True
            a = []
            for m, s in zip(members, sets, strict=True):
                both = int(mark[s].sum())
                if m != g["leader"][0] and threshold[1] * both >= threshold[0] * (len(sets[lead]) + len(s) - both):
                    a.append(m)
            if a:
                yield links(a, [g["leader"][0]] * len(a))

    return run


def confirmed(threshold: tuple[int, int], least: dict[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for g in grouped(batches, ["cell", "key", "lo", "hi"]):
            left, right = sides(g)
            words = [t.lower().split() for t in g["text"]]
            sig = signatures([shingle_hashes(w, hashes.of(w)) for w in words])
            f, a, b, seen = Forest(len(words)), [], [], {}
            for i, c in enumerate(g["comp"]):  # what is of one component by now needs no link
                f.tie(seen.setdefault(c, i), i)
            found = list(survivors(sig, least, left, right))
            if not found:
                continue
            i, j, m = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(-m, kind="stable")
            sets = exact_sets(words)
            mark = np.zeros(1 + max(int(s[-1]) for s in sets if len(s)), bool)
            for at in range(0, len(order), 4096):  # pairs that are connected by now are skipped
                label = np.array([f.find(k) for k in range(len(words))])
                part = order[at : at + 4096]
                part = part[label[i[part]] != label[j[part]]]
                part = part[np.argsort(i[part], kind="stable")]
                was = -1
                for p, q in zip(i[part].tolist(), j[part].tolist(), strict=True):
                    if f.find(p) == f.find(q):
                        continue
                    if p != was:
                        if was >= 0:
                            mark[sets[was]] = False
                        mark[sets[p]] = True
                        was = p
                    both = int(mark[sets[q]].sum())
                    if threshold[1] * both >= threshold[0] * (len(sets[p]) + len(sets[q]) - both):
                        f.tie(p, q)
                        a.append(g["member"][p])
                        b.append(g["member"][q])
                if was >= 0:
                    mark[sets[was]] = False
            if a:
                yield links(a, b)

    return run


def fetched(source: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """``wanted`` (doc, h, columns) with text: a bounded bit filter keeps most other texts out of the join."""
    power = max(FILTER_BITS[0], min(FILTER_BITS[1], (16 * max(1, wanted.count())).bit_length()))
    bits = bit_rows(wanted.select(F.xxhash64("doc", "h").alias("row")), "row", power)
    texts = probed(source.withColumn("row", F.xxhash64("doc", "h")), "row", F.broadcast(bits), power)
    return texts.join(wanted, ["doc", "h"]).select(*columns, "text")


def star_links(source: DataFrame, classes: DataFrame, hits: DataFrame, threshold: tuple[int, int], least: dict[int, int]) -> DataFrame:
    """Confirmed links (a, b) of classes with one leader each, of hits(key, member, leader)."""
    shared = hits.where("member <> leader").groupBy("member", "leader").agg(F.count("*").alias("bands"))
    pairs = shared.groupBy("member").agg(F.max_by("leader", F.struct("bands", -F.col("leader"))).alias("leader"))
    both = pairs.join(classes.select("member", "sig"), "member").join(classes.select(F.col("member").alias("leader"), F.col("sig").alias("leader_sig")), "leader")
    alive = stage(both.mapInArrow(pruned(least), "member long, leader long"), "star-pairs")
    # the members of a leader are dealt to cells of bounded bytes; the leader goes to each of them
    place = classes.select("member", "doc", "h", "bytes")
    sized = alive.join(place, "member")
    parts = sized.groupBy("leader").agg(F.ceil(F.sum(F.col("bytes") + 1) / CELL_BYTES).alias("parts"))
    members = sized.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")))
    leaders = parts.join(place.withColumnRenamed("member", "leader"), "leader").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    columns = ["doc", "h", "leader", "member", "part"]
    wanted = stage(members.select(*columns).unionByName(leaders.withColumn("member", F.col("leader")).select(*columns)), "star-texts")
    texts = fetched(source, wanted, columns[2:])
    return texts.repartition("leader", "part").sortWithinPartitions("leader", "part").mapInArrow(starred(threshold), "a long, b long")


def open_cells(hits: DataFrame, settled: DataFrame) -> DataFrame:
    """Cells of the buckets of hits(key, member) with several components of settled(node, component): cell, key, lo, hi, block, member, comp.

    Members of a bucket's largest component are not paired with each other.
    """
    m = hits.select("key", "member").join(settled, F.col("member") == F.col("node"), "left").select("key", "member", F.coalesce("component", "member").alias("comp"))
    m = stage(m, "bucket-members")
    sizes = m.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("size")).where("comps > 1")
    m = m.join(sizes, "key").withColumn("in_main", F.col("comp") == F.col("main.comp"))
    mains, others = (F.ceil(n / CELL_MEMBERS) for n in (F.col("main.n"), F.col("size") - F.col("main.n")))
    # blocks of the others come first, then those of the largest component
    block = F.pmod(F.xxhash64("member"), F.when(F.col("in_main"), mains).otherwise(others)) + F.when(F.col("in_main"), others).otherwise(0)
    m = m.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("in_main"), others).otherwise(others + mains) - 1)))
    m = m.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with")).withColumn("cell", F.xxhash64("key", "lo", "hi"))
    return m.select("cell", "key", "lo", "hi", "block", "member", "comp")


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked when ``threshold[1] * intersection >= threshold[0] * union`` of their 5-word shingle
    sets; component_id is the least id reachable. Null or wordless texts have empty sets and link
    with nothing; very long texts are compared whole, so one text must fit into a task. A null id counts as the least id, but rows
    without an id, or of one id, are documents of their own: they share a component only through their texts. Of equal similarities
    none is preferred. An empty table gives an empty result; other columns are not read.
    """
    source = id_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    s = stage(source.mapInArrow(signed, SIGNED), "signatures")
    least = least_matches(threshold[0] / threshold[1], miss)
    classes = s.where("n > 0").groupBy("sha").agg(F.min(F.struct("doc", "h", "bytes")).alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("member"), "sha", "first.*", "copies", "sig"), "classes")

    step = 2 * ROWS
    band = [F.xxhash64(F.lit(b), F.substring("sig", 1 + step * b, step)) for b in range(BANDS)]
    keys = classes.select("member", F.explode(F.array(*band)).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("member").alias("leader")).where("size > 1")
    hits = stage(keys.join(shared, "key").select("key", "member", "leader"), "hits")
    stars = stage(star_links(source, classes, hits, threshold, least), "star-links")
    # one component for what a leader and its own leader hold together; that more is connected may show later
    up = stars.select(F.col("a").alias("component"), F.col("b").alias("above"))
    settled = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).join(up, "component", "left")
    settled = stage(settled.select("node", F.coalesce("above", "component").alias("component")), "settled")

    dealt = open_cells(hits, settled).join(classes.select("member", "sig"), "member")
    dealt = dealt.select("cell", "key", "lo", "hi", "block", "member", "comp", "sig")
    forest = dealt.repartition("cell").sortWithinPartitions("cell", "key", "lo", "hi").mapInArrow(families(least), "a long, b long")
    family = connected_components(forest).select(F.col("node").alias("member"), F.col("component").alias("key"))
    family = family.join(settled, F.col("member") == F.col("node"), "left").select("key", "member", F.coalesce("component", "member").alias("comp"))
    family = stage(family.join(classes.select("member", "doc", "h", "bytes"), "member"), "families")
    sizes = family.groupBy("key").agg(F.sum(F.col("bytes") + 1).alias("total"))
    dealt = cells(family.join(sizes, "key"), "key", F.ceil(F.col("total") / CELL_BYTES)).select("cell", "key", "lo", "hi", "block", "member", "comp", "doc", "h")
    dealt = fetched(source, stage(dealt, "family-cells"), ["cell", "key", "lo", "hi", "block", "member", "comp"])
    checked = dealt.repartition("cell").sortWithinPartitions("cell", "key", "lo", "hi").mapInArrow(confirmed(threshold, least), "a long, b long")
    component = connected_components(stars.unionByName(checked))

    # back to all documents: least id by component, component by class, class by the sequence's digest
    own = classes.join(component, F.col("member") == F.col("node"), "left").select("sha", "copies", "doc", F.coalesce("component", "member").alias("component"))
    own = stage(own, "class-components")
    label = own.groupBy("component").agg(F.min("doc").alias("c"), F.count("*").alias("size"))
    own = joined_by_size(own, label, ["component"], "size", own.count()).select("sha", "copies", "c")
    full, empty = s.where("n > 0").select("doc", "n", "sha"), s.where("n = 0").select("doc", "n", F.col("doc").alias("c"))
    rows = joined_by_size(full, stage(own, "class-labels"), ["sha"], "copies", s.count()).select("doc", "n", "c").unionByName(empty)
    return rows.select(public_id(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), public_id(F.col("c")).alias("component_id"), (F.col("doc") == F.col("c")).alias("kept"))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), (85, 100))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.v AND c.r < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.r) AS component_id, min(c.r) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.v = d.doc_id GROUP BY d.doc_id
"""
