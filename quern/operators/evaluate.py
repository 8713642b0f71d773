"""Retrieval measures of a run(qid, docno, score) against qrels(qid, docno, rel), as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

P_CUTS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
RECALLS = tuple(i / 10 for i in range(11))


def iprec(recall: float) -> str:
    """The column of a recall level; ``measures`` names it with a point."""
    return f"iprec_at_recall_{recall:.2f}".replace(".", "_")


def ranked(run: DataFrame) -> DataFrame:
    """qid, docno, rank from 1: by score, ties by falling docno."""
    order = W.partitionBy("qid").orderBy(F.desc("score"), F.desc("docno"))
    rows = run.select(F.col("qid").cast("string").alias("qid"), F.col("docno").cast("string").alias("docno"), "score")
    return rows.withColumn("rank", F.row_number().over(order)).drop("score")


def per_query(run: DataFrame, qrels: DataFrame, complete: bool = False, ndcg: bool = False) -> DataFrame:
    """One row per query of run and qrels, one column per measure; ``complete``: queries of the qrels without results count 0.

    Relevant is rel > 0, judged not relevant is rel = 0; other rows are unjudged.
    """
    rel = qrels.select(F.col("qid").cast("string").alias("qid"), F.col("docno").cast("string").alias("docno"), F.col("rel").cast("int").alias("rel"))
    totals = rel.groupBy("qid").agg(F.count_if(F.col("rel") > 0).alias("num_rel"), F.count_if(F.col("rel") == 0).alias("n_bad"))
    up_to = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = ranked(run).join(rel, ["qid", "docno"], "left").withColumn("hit", F.when(F.col("rel") > 0, 1).otherwise(0))
    rows = rows.withColumns({"hits": F.sum("hit").over(up_to), "bads": F.count_if(F.col("rel") == 0).over(up_to)})
    rows = rows.join(totals, "qid").withColumn("prec", F.col("hits") / F.col("rank"))
    hit = F.col("hit") == 1
    held = F.least(F.col("num_rel"), F.col("n_bad"))
    sums = {
        "num_ret": F.count("*"),
        "num_rel_ret": F.sum("hit"),
        "map": F.sum(F.when(hit, F.col("prec"))),
        "Rprec": F.sum(F.when(F.col("rank") <= F.col("num_rel"), F.col("hit"))),
        "bpref": F.sum(F.when(hit, F.when(F.col("bads") == 0, 1.0).otherwise(1.0 - F.least("bads", "num_rel") / held))),
        "recip_rank": F.max(F.when(hit, 1.0 / F.col("rank"))),
    }
    sums |= {iprec(r): F.max(F.when(F.col("hits") >= F.floor(F.lit(r) * F.col("num_rel") + 0.9), F.col("prec"))) for r in RECALLS}
    sums |= {f"P_{k}": F.sum(F.when(F.col("rank") <= k, F.col("hit"))) / k for k in P_CUTS}
    gain = F.greatest(F.col("rel"), F.lit(0)) / F.log2(F.col("rank") + 1)
    if ndcg:
        sums |= {f"ndcg_cut_{k}": F.sum(F.when(F.col("rank") <= k, gain)) for k in P_CUTS}
    got = rows.groupBy("qid").agg(*(c.alias(n) for n, c in sums.items()))
    out = totals.join(got, "qid", "left" if complete else "inner")
    if ndcg:
        best = rel.where("rel > 0").withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"))))
        ideal = best.groupBy("qid").agg(*(F.sum(F.when(F.col("rank") <= k, gain)).alias(f"ideal_{k}") for k in P_CUTS))
        out = out.join(ideal, "qid", "left")
    share = {c: F.col(c) / F.col("num_rel") for c in ("map", "Rprec", "bpref")}
    share |= {f"ndcg_cut_{k}": F.col(f"ndcg_cut_{k}") / F.col(f"ideal_{k}") for k in P_CUTS} if ndcg else {}
    columns = [F.coalesce(F.when(F.col("num_rel") > 0, share.get(c, F.col(c))), F.lit(0)).alias(c) if c in share else F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums]
    return out.select("qid", "num_rel", *columns)


def measures(per: DataFrame, query_eval: bool = False) -> DataFrame:
    """Long form (qid, measure, value): row "all" of sums and means, and each query with ``query_eval``."""
    counts, means = ["num_ret", "num_rel", "num_rel_ret"], [c for c in per.columns if c not in ("qid", "num_ret", "num_rel", "num_rel_ret")]
    both = [F.count("*").cast("double").alias("num_q")]
    both += [F.sum(c).cast("double").alias(c) for c in counts] + [F.avg(c).alias(c) for c in means]
    both.append(F.exp(F.avg(F.log(F.greatest(F.col("map"), F.lit(1e-5))))).alias("gm_map"))
    whole = per.agg(*both).withColumn("qid", F.lit("all"))
    out = whole.unpivot("qid", [c for c in whole.columns if c != "qid"], "measure", "value")
    if query_eval:
        rows = per.select("qid", *(F.col(c).cast("double").alias(c) for c in counts + means))
        out = out.unionByName(rows.unpivot("qid", counts + means, "measure", "value"))
    named = F.regexp_replace("measure", "^(iprec_at_recall_[01])_", "$1.")
    return out.select("qid", named.alias("measure"), "value")


def evaluate(run: DataFrame, qrels: DataFrame, complete: bool = False, ndcg: bool = False, query_eval: bool = False) -> DataFrame:
    return measures(per_query(run, qrels, complete, ndcg), query_eval)


def cost(run: DataFrame) -> DataFrame:
    """One row (average_cost, total_cost) over the queries with results; a query's cost is on each of its rows."""
    each = run.groupBy("qid").agg(F.min("postings_cost").alias("c"))
    return each.agg(F.avg("c").alias("average_cost"), F.sum("c").alias("total_cost"))
