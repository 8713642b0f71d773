"""Comparing experiments: parameter grids, parsed evaluations, sign tests, n-gram queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prob import sign_test_p
from ..index import Index, build_index
from ..sources import readers, writers
from . import evaluate, rank

CONFIG = ("mode", "stopwords", "min_freq", "min_pmi")
#: Up to so many needles every text is tested against all; beyond, texts and needles meet by their first letters.
FEW_NEEDLES = 2048
KEY = 6


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """One row per combination of the given parameter values."""
    rows = [()]
    for v in values.values():
        rows = [(*r, x) for r in rows for x in v]
    return spark.createDataFrame(rows, list(values))


def default_grid(spark: SparkSession, min_freqs: list[int], min_pmis: list[float], limit: int = -1) -> DataFrame:
    """Stop lists, modes, minimal frequencies and PMIs; word mode has no use for the latter two and comes once a stop list."""
    g = grid(spark, stopwords=["english", "none"], mode=["words", "phrases"], limit=[limit], min_freq=min_freqs, min_pmi=min_pmis)
    return g.where((F.col("mode") == "phrases") | ((F.col("min_freq") == min_freqs[0]) & (F.col("min_pmi") == min_pmis[0])))


def parse_evaluations(lines: DataFrame) -> DataFrame:
    """(path, query, mode, stopwords, min_freq, min_pmi, metric, value) of lines(path, value).

    Lines are ``metric all value`` or ``Name: value``. The file's name holds the configuration between
    underscores; a folder of digits above it is the query, else it is ``all``. Missing parts are ``unknown``. Of files that Spark
    wrote (part-...) the folder counts as the name; ``column=`` before a name is left out.
    """
    table = r"^(\S+)\s+all\s+(-?[0-9.eE+-]+)\s*$"
    named = r"^([^:]+):\s*(-?[0-9.eE+-]+)\s*$"
    v = F.col("value")
    is_table = v.rlike(table)
    metric = F.when(is_table, F.regexp_extract(v, table, 1)).otherwise(F.replace(F.lower(F.trim(F.regexp_extract(v, named, 1))), F.lit(" "), F.lit("_")))
    number = F.when(is_table, F.regexp_extract(v, table, 2)).otherwise(F.regexp_extract(v, named, 2)).try_cast("double")
    steps = F.transform(F.split(F.regexp_replace("path", "/part-[^/]*$", ""), "/"), lambda s: F.regexp_replace(s, "^[a-z_]+=", ""))
    parts = F.split(F.regexp_replace(F.try_element_at(steps, F.lit(-1)), r"\.[^.]*$", ""), "_")
    folder = F.try_element_at(steps, F.lit(-2))
    config = [F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("unknown")).alias(c) for i, c in zip((2, 3, 5, 6), CONFIG, strict=True)]
    query = F.when(folder.rlike("^[0-9]+$"), folder).otherwise(F.lit("all")).alias("query")
    return lines.where(v.rlike(table) | v.rlike(named)).select("path", query, *config, metric.alias("metric"), number.alias("value"))


def evaluation_table(parsed: DataFrame) -> DataFrame:
    """One row per query and configuration, one column per metric."""
    return parsed.groupBy("query", *CONFIG).pivot("metric").agg(F.first("value"))


def batch_search(indexes: dict[str, Index], query_sets: dict[str, DataFrame], models: tuple[str, ...] = ("lm",), limit: int = 1000) -> DataFrame:
    """Every query set against every index under every model: (config, qid, docno, rank, score, postings_cost).

    ``config`` is index/queries/model. The runs are one plan over stored indexes; only query terms are staged on the way.
    """
    runs = []
    for index, i in indexes.items():
        for queries, q in query_sets.items():
            runs += [rank.search(i, q, m, limit).withColumn("config", F.lit(f"{index}/{queries}/{m}")) for m in models]
    return reduce(DataFrame.unionByName, runs)


def batch_evaluate(runs: DataFrame, qrels: DataFrame, complete: bool = False, ndcg: bool = False) -> DataFrame:
    """``evaluate.per_query`` of all runs(config, qid, docno, score) at once: config, qid and a column per measure."""
    key = F.concat_ws("\t", "config", F.col("qid").cast("string"))
    configs = F.broadcast(runs.select("config").distinct())  # as many rows as experiments
    judged = qrels.crossJoin(configs).select(key.alias("qid"), "docno", "rel")
    per = evaluate.per_query(runs.select(key.alias("qid"), "docno", "score"), judged, complete, ndcg)
    parts = F.split("qid", "\t")
    return per.select(parts[0].alias("config"), parts[1].alias("qid"), *per.columns[1:])


def run_experiment(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, path: str, mode: str = "standard", model: str = "lm", limit: int = 1000, **settings) -> DataFrame:
    """Index, search, evaluate: the index, the run, the settings and the evaluation are stored below ``path``; returns (measure, value) of all queries."""
    spark = corpus.sparkSession
    index = build_index(corpus, mode, **settings).save(f"{path}/index")
    run = rank.search(index, queries, model, limit)
    writers.write_run(run, f"{path}/run", model)
    writers.write_settings(spark, {"mode": mode, "model": model, "limit": limit} | settings, f"{path}/settings")
    evaluate.evaluate(readers.read_run(spark, f"{path}/run"), qrels).write.parquet(f"{path}/evaluation")
    return spark.read.parquet(f"{path}/evaluation").select("measure", "value")


def sign_test(a: DataFrame, b: DataFrame, value: str, lower_is_better: bool = False, by: list[str] | None = None) -> DataFrame:
    """by..., n_pairs, better, worse, equal, p_value: rows of ``a`` against those of ``b`` with the same qid; null values drop out.

    p is the two-sided exact binomial tail at one half, null without an untied pair.
    """
    by = by or []
    left = a.select(*by, "qid", F.col(value).alias("x")).where("x IS NOT NULL")
    right = b.select("qid", F.col(value).alias("y")).where("y IS NOT NULL")
    up, down = (F.col("x") < F.col("y"), F.col("x") > F.col("y")) if lower_is_better else (F.col("x") > F.col("y"), F.col("x") < F.col("y"))
    out = left.join(right, "qid").groupBy(*by).agg(
        F.count("*").alias("n_pairs"), F.count_if(up).alias("better"), F.count_if(down).alias("worse"), F.count_if(F.col("x") == F.col("y")).alias("equal")
    )
    return out.withColumn("p_value", sign_test_p(F.col("better"), F.col("worse")))


def sign_tests(table: DataFrame, metric: str, lower_is_better: bool = False, base_freq: str = "1", base_pmi: str = "24") -> DataFrame:
    """Every configuration of an evaluation table against the one of the same mode and stop words at base_freq and base_pmi."""
    keys = ["mode", "stopwords"]
    base = table.where((F.col("min_freq") == base_freq) & (F.col("min_pmi") == base_pmi)).select(*keys, "query", F.col(metric).alias("y"))
    rows = table.select(*CONFIG, "query", F.col(metric).alias("x")).where("x IS NOT NULL").join(base.where("y IS NOT NULL"), [*keys, "query"])
    up, down = (F.col("x") < F.col("y"), F.col("x") > F.col("y")) if lower_is_better else (F.col("x") > F.col("y"), F.col("x") < F.col("y"))
    out = rows.groupBy(*CONFIG).agg(F.count("*").alias("n_pairs"), F.count_if(up).alias("better"), F.count_if(down).alias("worse"), F.count_if(F.col("x") == F.col("y")).alias("equal"))
    return out.withColumn("p_value", sign_test_p(F.col("better"), F.col("worse")))


def _substrings(col: str, n: int) -> Column:
    """The distinct substrings of n letters, found in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(F.col(col), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def containments(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """texts(id, text) with each needles(needle_id, needle) they contain: (id, needle_id). Empty needles and nulls match nothing.

    Ids are distinct. Few needles are sent to the texts, and looked for by a search that leaps over what can't match. Many meet the texts' substrings by the needle's first letters; only
    the ids and those letters move, and a text is fetched once, together with all needles that it may contain.
    """
    wanted = needles.where(F.length("needle") > 0)
    some = wanted.select("needle_id", "needle").limit(FEW_NEEDLES + 1).collect()
    if len(some) <= FEW_NEEDLES:
        given = T.StructType([T.StructField("nr", T.IntegerType()), T.StructField("needle_id", wanted.schema["needle_id"].dataType)])
        ids = texts.sparkSession.createDataFrame([(i, r.needle_id) for i, r in enumerate(some)], given)
        found = texts.select("id", F.col("text").cast("string").alias("text")).mapInArrow(
            _holding([r.needle for r in some]), T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("nr", T.IntegerType())])
        )
        return found.join(F.broadcast(ids), "nr").select("id", "needle_id")
    keyed = texts.select("id", F.explode(_substrings("text", KEY)).alias("key"))
    long = wanted.where(F.length("needle") >= KEY).withColumn("key", F.substring("needle", 1, KEY))
    maybe = keyed.join(long, "key").groupBy("id").agg(F.collect_list(F.struct("needle_id", "needle")).alias("maybe"))
    rows = texts.join(maybe, "id").select("id", F.inline(F.filter("maybe", lambda m: F.contains(F.col("text"), m["needle"]))))
    out = rows.select("id", "needle_id")
    for n in range(1, KEY):
        grams = texts.select("id", F.explode(_substrings("text", n)).alias("needle"))
        out = out.unionByName(grams.join(wanted.where(F.length("needle") == n), "needle").select("id", "needle_id"))
    return out


def _holding(needles: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, nr) of (id, text): the places of the needles that a text contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [(i, nr) for i, t in enumerate(texts) if t for nr, n in enumerate(needles) if n in t]
            rows, nrs = (pa.array([x[k] for x in found], pa.int32()) for k in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), nrs], names=["id", "nr"])

    return run


def queries_with_ngrams(queries: DataFrame, ngrams: DataFrame, least: int = 2) -> DataFrame:
    """queries(qid, text) whose text contains at least ``least`` of ngrams(term), with their number; case means nothing."""
    texts = queries.select(F.col("qid").alias("id"), F.lower("text").alias("text"))
    needles = ngrams.select(F.lower(F.trim("term")).alias("needle")).distinct().withColumn("needle_id", F.col("needle"))
    found = containments(texts, needles).groupBy("id").agg(F.count("*").alias("n_ngrams")).where(F.col("n_ngrams") >= least)
    return queries.join(found, F.col("qid") == F.col("id")).select("qid", "text", "n_ngrams")
