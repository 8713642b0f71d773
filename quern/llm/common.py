"""Shared plumbing of the training-data operators: samples, bit filters, components."""

from __future__ import annotations

from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import remove, shared_dir, stage  # noqa: F401 (operators import all shared plumbing from here)

SPACE = r"[ \t-\r]"  # the six separators of the contracts: \x20 and \x09-\x0D


def bit_rows(keys: DataFrame, key: str, power: int) -> DataFrame:
    """(bucket, bits): a bit set for each key's slot of 2**power, in rows of 4 KB. Slots move, partial rows do not."""
    slot = F.col(key).bitwiseAND(F.lit((1 << power) - 1))
    at = keys.select(F.shiftright(slot, 15).alias("bucket"), (slot % 32768).alias("at"))
    return at.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def probed(rows: DataFrame, key: str, bits: DataFrame, power: int) -> DataFrame:
    """The rows whose key's slot is set in ``bits``, which is to be marked for broadcast where that is due."""
    slot = F.col(key).bitwiseAND(F.lit((1 << power) - 1))
    at = (slot % 32768).cast("int")
    found = rows.withColumn("bucket", F.shiftright(slot, 15)).join(bits, "bucket")
    byte = F.conv(F.hex(F.substring("bits", 1, 4096).substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("bucket", "bits")


def joined_by_size(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``table``, one row a key, ``size`` of whose keys' rows it has, of ``total`` rows in all.

    Keys with more than a 1,024th of all rows, thus fewer than 1,024 keys, are broadcast, so no task gets the rows of a hot one.
    """
    most = total // 1024
    hot = F.broadcast(table.where(F.col(size) > most))
    others = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(size) <= most), keys, "left")
    return rows.join(hot, keys).unionByName(others)


def least_hashed(rows: DataFrame, limits: dict, counts: dict, most_bytes: int) -> list[tuple]:
    """(key, class): of each class of ``rows(key long, cls, bytes)`` the limits[class] rows with the least hashes of their key.

    ``counts`` has the rows of each class. A class gets an even share of ``most_bytes``: in order of the hashes, rows that
    would go beyond it are passed over. A hash bound that twice the limit should stay under comes before the window,
    so the window gets about that many rows a class from all tasks together; a class that it leaves
    short, as when few keys repeat a lot, is picked again from all its rows.
    """
    by = lambda of: F.create_map(*chain.from_iterable((F.lit(c), F.lit(v)) for c, v in of.items()))[F.col("cls")]
    h = F.xxhash64("key")

    def pick(bounds: dict) -> list:
        if not bounds:
            return []
        under = rows.where(h <= by(bounds)).select("key", "cls", "bytes")
        ranked = under.withColumn("k", F.row_number().over(W.partitionBy("cls").orderBy(h, "key"))).where(F.col("k") <= max(limits.values()))
        return ranked.where(F.col("k") <= by(limits)).orderBy("cls", "k").collect()

    top = (1 << 63) - 1
    share = {c: (2 * limits[c] + 100) / max(1, n) for c, n in counts.items()}
    got = pick({c: top if f >= 1 else int(f * (1 << 64)) - (1 << 63) for c, f in share.items()})
    have = Counter(r["cls"] for r in got)
    short = {c for c, n in counts.items() if have[c] < min(n, limits[c])}
    out, used = [], Counter()
    for r in [g for g in got if g["cls"] not in short] + pick(dict.fromkeys(short, top)):
        if used[r["cls"]] + r["bytes"] <= most_bytes // max(1, len(counts)):
            used[r["cls"]] += r["bytes"]
            out.append((r["key"], r["cls"]))
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges(a, b)``; component is the least node.

    Alternating large-star and small-star passes: every pass is a partial
    aggregate and an equi-join, so a hub's neighbours are spread by the skewed
    join, and the number of passes is logarithmic in the longest chain. Every
    pass is written to the shared folder. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    paths: list[str] = []

    def put(df: DataFrame, seen: Observation | None = None) -> DataFrame:
        paths.append(shared_dir(spark, "cc"))
        if seen is not None:  # a mark of the edges, summed up while they are written
            df = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.sum(F.xxhash64("b", "a") % 1000003).alias("x"))
        df.write.parquet(paths[-1])
        while len(paths) > 2:
            remove(spark, paths.pop(0))
        return spark.read.schema("a long, b long").parquet(paths[-1])

    seen = Observation()
    e = put(e, seen)
    mark = seen.get
    while True:
        # large star: every larger neighbour of u is tied to the least of u and its neighbours
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: u and its smaller neighbours are tied to the least of them
        e = put(large)
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        seen = Observation()
        e = put(small.union(least.select("a", F.col("m").alias("b"))).distinct(), seen)
        was, mark = mark, seen.get
        if mark == was:
            break
    # at the fixed point every node hangs from its root directly
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
