"""Writers: runs, judgments, samples, one query a file, tables, settings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def run_lines(run: DataFrame, tag: str = "lm") -> DataFrame:
    """value: ``qid Q0 docno rank score tag cost`` of search results, ranks from 0."""
    return run.select(F.concat_ws(" ", "qid", F.lit("Q0"), "docno", "rank", F.col("score").cast("string"), F.lit(tag), "postings_cost").alias("value"), "qid", "rank")


def write_run(run: DataFrame, path: str, tag: str = "lm", mode: str = "error") -> None:
    """The lines by query and rank: every query in one part file."""
    run_lines(run, tag).repartitionByRange("qid").sortWithinPartitions("qid", "rank").select("value").write.mode(mode).text(path)


def write_qrels(qrels: DataFrame, path: str, mode: str = "error") -> None:
    """``qid 0 docno rel`` lines."""
    qrels.select(F.concat_ws(" ", "qid", F.lit("0"), "docno", "rel").alias("value")).write.mode(mode).text(path)


def write_sample(sample: DataFrame, path: str, mode: str = "error") -> None:
    """``x<tab>y`` lines by x."""
    sample.orderBy("x").select("x", "y").write.mode(mode).csv(path, sep="\t")


def one_line(text: Column) -> Column:
    """Line ends and tabs as spaces: the formats hold a query a line."""
    return F.regexp_replace(text, "[\t\n\r]+", " ")


def write_queries(queries: DataFrame, path: str, mode: str = "error") -> None:
    """``qid<tab>text`` lines, as ``read_queries`` takes them."""
    queries.select(F.concat_ws("\t", "qid", one_line(F.col("text"))).alias("value")).write.mode(mode).text(path)


def split_queries(queries: DataFrame, path: str, mode: str = "error") -> None:
    """A folder for each query, ``qid=...``, with its one line ``text``."""
    queries.select("qid", one_line(F.col("text")).alias("text")).repartition("qid").write.mode(mode).partitionBy("qid").text(path)


def write_table(df: DataFrame, path: str, *order: str, mode: str = "error") -> None:
    """CSV with a header: columns by name, rows in the given order."""
    (df.orderBy(*order) if order else df).select(*sorted(df.columns)).write.mode(mode).csv(path, header=True)


def write_settings(spark: SparkSession, settings: dict, path: str, mode: str = "error") -> None:
    """An experiment's settings as one JSON line."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode(mode).text(path)


def write_evaluations(lines: DataFrame, path: str, mode: str = "error") -> None:
    """lines(query, config, value) as texts in folders by query and configuration, as ``parse_evaluations`` takes them apart."""
    lines.select("query", "config", "value").repartition("query", "config").write.mode(mode).partitionBy("query", "config").text(path)
