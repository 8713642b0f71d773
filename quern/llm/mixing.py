"""Mixing sources to target weights by Poisson replication, DataFrame operations only.

A document of source s should appear rate_s = weight_s * budget / count_s times on
average. Its number of copies is the quantile of a Poisson distribution with that mean
at a uniform number taken from a keyed hash of its id, so the draw does not depend on
partitioning, retries or order. Copies are then dealt to partitions and sorted by a
second hash: a global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sources up to this number are broadcast (some 10 MB of rates); beyond it the rates are joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: A mean above this draws several independent Poisson numbers, so one table of probabilities stays short.
MAX_MEAN = 64.0


def uniform(*parts):
    """52 bits of MD5 of the parts as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None, size: float | None, source_col: str) -> DataFrame:
    """(source, known, rate, draws, cdf): mean repetition and the cumulative probabilities of one draw.

    ``weights`` maps source to target weight (missing sources get 0); None weighs all sources alike.
    ``size`` is the expected number of rows of the mixture, the number of input rows by default.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        w = F.lit(1.0)
    else:
        w = F.lit(0.0)
        for k, v in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(w)
    counts = counts.withColumn("w", w)
    total = counts.agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))
    rate = F.when(F.col("tw") > 0, F.col("w") / F.col("tw") * (F.lit(float(size)) if size is not None else F.col("tn")) / F.col("n")).otherwise(0.0)
    r = counts.join(F.broadcast(total)).select("source", rate.alias("rate"))
    r = r.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN).cast("int"))).withColumn("mean", F.col("rate") / F.col("draws"))
    # P(X <= k) for k = 0 .. mean + 12 sqrt(mean) + 24, each term from the one before
    top = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 24).cast("int")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return r.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), top), start, step)["cdf"])


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, size: float | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The mixture: every input row ``copies`` times, columns as given plus ``copy``, ``copies``, ``shuffle_key``.

    Rows with a null source form a source of their own; a null id draws as the text 'null'.
    Rows that repeat an id draw alike, and copies of equal key lie in any order; texts, null, empty or very long, are carried along
    unread. Sources without weight give no rows; an empty table gives none.
    Input columns named like the three new ones are replaced.
    """
    cols = [f"`{c}`" for c in (keep or tuple(docs.columns)) if c.lower() not in ("copy", "copies", "shuffle_key")]
    r = rates(docs, weights, size, source_col).select(F.col("source").alias("__source"), F.col("draws").alias("__draws"), F.col("cdf").alias("__cdf"))
    n_sources = docs.select(source_col).distinct().count()
    side = F.broadcast(r) if n_sources <= BROADCAST_SOURCES else r
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    x = docs.select(*cols, ident.alias("__id"), F.col(source_col).alias("__from")).join(side, F.col("__from").eqNullSafe(F.col("__source")))

    def one(i):
        u = uniform(F.lit(str(seed)), i.cast("string"), F.col("__id"))
        return F.size(F.filter("__cdf", lambda c: c <= u))

    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("__draws")), one), F.lit(0), lambda a, b: a + b)
    x = x.select(*cols, "__id", copies.alias("copies")).where("copies > 0")
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}/shuffle"), F.col("copy").cast("string"), F.col("__id")))
    x = x.select(*cols, "copy", "copies", key.alias("shuffle_key"))
    return x.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """All sources of ``documents`` at equal weight, as many rows as before on average."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id", "source", "text"))


OP5_SQL = """
WITH RECURSIVE n AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT CAST(count(*) AS DOUBLE) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
m AS (SELECT source, greatest(1, CAST(ceil(rate / 64.0) AS INTEGER)) AS draws, rate / greatest(1, CAST(ceil(rate / 64.0) AS INTEGER)) AS mean FROM r),
c AS (SELECT source, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM m
      UNION ALL SELECT source, draws, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c
      WHERE k < ceil(mean + 12 * sqrt(mean) + 24)),
t AS (SELECT source, any_value(draws) AS draws, list(cdf) AS cdf FROM c GROUP BY source),
u AS (SELECT doc_id, d.source, text, cdf, i,
        CAST(('0x' || substr(md5('17|' || i || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
      FROM documents d JOIN t ON d.source IS NOT DISTINCT FROM t.source, LATERAL (SELECT unnest(range(1, draws + 1)) AS i)),
k AS (SELECT doc_id, source, text, CAST(sum(len(list_filter(cdf, lambda x: x <= u))) AS INTEGER) AS copies FROM u GROUP BY doc_id, source, text),
e AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM k)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, copies,
       md5('17/shuffle|' || copy || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS shuffle_key FROM e
"""
