"""Embedding near-dedup with a pivot-permutation index.

Vectors of equal direction, to the bit, are one class with the number of its rows, so copies cost nothing beyond a count.
Reference points (pivots) come from a bounded sample of classes, thinned so that no two are close. Each
class is described by the order of its nearest pivots; the first PREFIX of them post it to inverted
lists. A list is kept for every pair of pivots, that is the candidates with a shared-pivot
count of two or more; each pair of classes is judged only in the list of the two least pivots that it
shares, so it is counted once. Long lists are dealt out in cells of bounded size. Candidates are verified by
cosine in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, joined_by_size, stage
from .minhash import Forest, cells, grouped, sides
from .words import LEAST_ID, public_id

#: Classes from which pivots are chosen (those with the least hashes; four a pivot, SAMPLE at least), and how close two pivots may be.
SAMPLE, APART = 8192, 0.8
#: Nearest pivots that post a vector.
PREFIX = 6
#: Pivots are about the root of the number of vectors, at most so many and in so many bytes: they are broadcast.
MOST_PIVOTS, PIVOT_BYTES = 1 << 15, 64 << 20
CELL_MEMBERS = 2048
FOUND = "kind int, a long, b long"


def unit(v) -> np.ndarray | None:
    """The vector at length one in double precision; None if it is null, empty, zero or not finite."""
    if v is None:
        return None
    x = np.array([np.nan if c is None else c for c in v], np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    x = x / max(np.abs(x).max(), np.finfo(float).tiny)
    n = np.sqrt(x @ x)
    return x / n if n > 0 else None


def pivots_of(sample: list[np.ndarray], count: int) -> dict[int, np.ndarray]:
    """Per dimension up to ``count`` pivots, each less than APART from those before it (relaxed if too few remain)."""
    by: dict[int, list[np.ndarray]] = {}
    for u in sample:
        by.setdefault(len(u), []).append(u)
    out = {}
    for dim, rows in by.items():
        x = np.array(rows)
        near, own = np.full(len(x), -1.0), []
        for i in range(len(x)):
            if len(own) == count:
                break
            if near[i] < APART:
                own.append(i)
                near = np.maximum(near, x @ x[i])
        out[dim] = x[own]
    return out


def pivots_for(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """Sampled pivots; directions drawn at random for a dimension that the sample has too few of."""
    p = pivots.get(dim)
    if p is None or len(p) < 2 * PREFIX:
        r = np.random.default_rng(dim).normal(size=(64, dim))
        pivots[dim] = p = r / np.linalg.norm(r, axis=1, keepdims=True)
    return p


def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, unit, k): vectors at length one, and the digest of their bytes; null for those that link with nothing."""
    for batch in batches:
        units = [None if u is None else u.tobytes() for u in map(unit, batch.column("v").to_pylist())]
        k = [None if u is None else hashlib.sha256(u).digest() for u in units]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(units, pa.binary()), pa.array(k, pa.binary())], names=["id", "unit", "k"])


def described(shared) -> object:
    """(member, near): the nearest pivots of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = dict(shared.value)
        for batch in batches:
            units = [np.frombuffer(u) for u in batch.column("unit").to_pylist()]
            near: list = [None] * len(units)
            for dim in {len(u) for u in units}:
                at = [i for i, u in enumerate(units) if len(u) == dim]
                p = pivots_for(pivots, dim)
                k = min(PREFIX, p.shape[0])
                for a in range(0, len(at), 256):
                    own = at[a : a + 256]
                    x = np.array([units[i] for i in own]) @ p.T
                    few = np.argpartition(-x, k - 1, axis=1)[:, :k] if p.shape[0] > k else np.tile(np.arange(k), (len(own), 1))
                    few = np.take_along_axis(few, np.argsort(-np.take_along_axis(x, few, axis=1), axis=1, kind="stable"), axis=1)
                    for i, o in zip(own, few, strict=True):
                        near[i] = o.astype(np.int32).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("member"), pa.array(near, pa.list_(pa.int32()))], names=["member", "near"])

    return run


def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(member, key, lesser, greater) for every pair of a vector's nearest pivots."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for m, near, size in zip(*(batch.column(c).to_pylist() for c in ("member", "near", "size")), strict=True):
            for a, b in combinations(sorted(near), 2):
                for c, x in zip(out, (m, (size << 32) | (a << 16) | b, a, b), strict=True):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["member", "key", "p", "q"])


def verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["cell", "key", "lo", "hi"]):
            left, right = sides(g)
            if not len(left) or not len(right) or len(g["member"]) < 2:
                continue
            x = np.frombuffer(b"".join(g["unit"])).reshape(len(g["unit"]), -1)
            weight = np.array(g["rows"], np.int64)
            p, q = g["p"][0], g["q"][0]
            used = sorted({n for near in g["near"] for n in near if n < q and n != p})
            place = {n: i for i, n in enumerate(used)}
            lesser = np.zeros((len(x), max(1, len(used))), np.float32)
            for i, near in enumerate(g["near"]):
                for n in near:
                    if n in place:
                        lesser[i, place[n]] = 1
            ok = (x[left] @ x[right].T >= threshold) & (lesser[left] @ lesser[right].T == 0)
            if left is right:
                np.fill_diagonal(ok, False)
            n = np.zeros(len(x), np.int64)
            n[left] += ok @ weight[right]
            if left is not right:
                n[right] += weight[left] @ ok
            if not n.any():
                continue
            f, out = Forest(len(x)), ([], [], [])
            for i in np.flatnonzero(ok.any(axis=1)).tolist():
                for j in right[np.flatnonzero(ok[i])].tolist():
                    if f.tie(int(left[i]), j):
                        for c, v in zip(out, (1, g["member"][left[i]], g["member"][j]), strict=True):
                            c.append(v)
            for i in np.flatnonzero(n).tolist():
                for c, v in zip(out, (0, g["member"][i], int(n[i])), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["kind", "a", "b"])

    return run


def chosen_pivots(classes: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Pivots from the classes with the least hashes; a bound on the hash comes before their order, so few of them move."""
    count = 64
    while count < MOST_PIVOTS and count * count < size:
        count *= 2
    wanted = max(SAMPLE, 4 * count)
    h = F.xxhash64("k")
    rows = classes if size <= 2 * wanted else classes.where(h <= int((2 * wanted / size) * (1 << 64)) - (1 << 63))
    widest = classes.agg(F.max(F.length("unit"))).first()[0] or 8
    wanted = min(wanted, 4 * max(1, PIVOT_BYTES // widest))
    sample = [np.frombuffer(r.unit) for r in rows.orderBy(h, "k").limit(wanted).select("unit").collect()]
    return pivots_of(sample, min(count, max(1, PIVOT_BYTES // widest)))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Null, empty, zero vectors and those with null or non-finite components link with nothing, as do vectors of
    different length. Every row is a vector of its own, whatever its id: rows without an id, or of one id, share a component
    only through their vectors. A null id counts as the least id. Cosines equal to the threshold link. An empty
    table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = stage(v.mapInArrow(directions, "id long, unit binary, k binary"), "directions")
    classes = v.where("k is not null").groupBy("k").agg(F.first("unit").alias("unit"), F.count("*").alias("rows"), F.min("id").alias("least"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("member"), "k", "unit", "rows", "least"), "classes")
    size, total = classes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    pivots = spark.sparkContext.broadcast(chosen_pivots(classes, size))
    d = stage(classes.select("member", "unit").mapInArrow(described(pivots), "member long, near array<int>"), "described")
    d = d.join(classes.select("member", "unit", "rows"), "member")
    lists = d.select("member", "near", F.length("unit").alias("size")).mapInArrow(posted, "member long, key long, p int, q int")
    sizes = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    hits = lists.join(sizes, "key").join(d, "member")
    dealt = cells(hits, "key", F.ceil(F.col("n") / CELL_MEMBERS)).select("cell", "key", "lo", "hi", "block", "member", "rows", "unit", "near", "p", "q")
    found = stage(dealt.repartition("cell").sortWithinPartitions("cell", "key", "lo", "hi").mapInArrow(verified(threshold), FOUND), "links")
    n = found.where("kind = 0").groupBy(F.col("a").alias("member")).agg(F.sum("b").alias("others"))
    component = connected_components(found.where("kind = 1").select("a", "b"))
    own = classes.select("member", "k", "rows", "least").join(n, "member", "left").join(component, F.col("member") == F.col("node"), "left")
    links = F.coalesce("others", F.lit(0).cast("long")) + F.col("rows") - 1
    own = stage(own.select("k", "rows", "least", links.alias("n_links"), F.coalesce("component", "member").alias("component")), "class-links")
    label = own.groupBy("component").agg(F.min("least").alias("c"), F.count("*").alias("size"))
    own = stage(joined_by_size(own, label, ["component"], "size", size).select("k", "rows", "n_links", "c"), "class-labels")
    full, none = v.where("k is not null").select("id", "k"), v.where("k is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("c"))
    out = joined_by_size(full, own, ["k"], "rows", total).select("id", "n_links", "c").unionByName(none)
    return out.select(public_id(F.col("id")).alias("vec_id"), "n_links", public_id(F.col("c")).alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT vec_id AS v, vec_id AS r FROM v UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.v AND c.r < l.b)
SELECT v.vec_id, CAST(coalesce(any_value(k.n), 0) AS BIGINT) AS n_links, min(c.r) AS component_id, min(c.r) = v.vec_id AS kept
FROM v JOIN c ON c.v = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = v.vec_id GROUP BY v.vec_id
"""
