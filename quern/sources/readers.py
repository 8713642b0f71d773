"""Readers of collections, queries, judgments, priors, n-gram lists and evaluation texts, all by schema, none inferred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Named collections: a function from a session to corpus(did, content), queries(qid, text) and qrels(qid, docno, rel).
COLLECTIONS: dict[str, Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]]] = {}


def register_collection(name: str, load: Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]]) -> None:
    """Makes a collection known by a short name to ``collection`` and the command line."""
    COLLECTIONS[name] = load


def collection(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    if name not in COLLECTIONS:
        raise ValueError(f"unknown collection {name!r}; known are {sorted(COLLECTIONS)}")
    return COLLECTIONS[name](spark)


def _mini(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A hand-made collection for trials: accents, hyphens, case, repeated words, an empty document."""
    docs = [
        ("a", "Café culture: coffee, coffee and more COFFEE."), ("b", "High-speed rail links the north and the south."), ("c", "Rail freight is slow; high freight rates are not."),
        ("d", "The naïve reader's résumé"), ("e", ""), ("f", "coffee trade by rail in 1905"), ("g", "South coast weather: wind, wind, rain"),
    ]
    return (
        spark.createDataFrame(docs, "did string, content string"),
        spark.createDataFrame([("1", "coffee trade"), ("2", "rail freight"), ("3", "north wind")], "qid string, text string"),
        spark.createDataFrame([("1", "f", 2), ("1", "a", 1), ("2", "c", 1), ("2", "b", 0), ("3", "g", 1)], "qid string, docno string, rel int"),
    )


register_collection("mini", _mini)


def corpus_of(df: DataFrame, id_col: str = "did", parts: tuple[str, ...] = ("title", "body", "text", "content")) -> DataFrame:
    """corpus(did, content): the columns of ``parts`` that are there, nulls left out, joined by spaces."""
    found = [F.col(c).cast("string") for c in parts if c in df.columns]
    if not found:
        raise ValueError(f"none of {parts} among {df.columns}")
    return df.select(F.col(id_col).cast("string").alias("did"), F.concat_ws(" ", *found).alias("content"))


def read_corpus(spark: SparkSession, path: str, form: str = "parquet", id_col: str = "did", **options) -> DataFrame:
    """A collection stored as parquet, orc, json, csv or any other form that Spark reads. Text columns only are scanned."""
    return corpus_of(spark.read.format(form).options(**options).load(path), id_col)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """queries(qid, text) of lines ``qid<tab>text``; quotes mean nothing. A line with another number of parts is an error."""
    parts = F.split("value", "\t")
    checked = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not two parts: "), F.col("value"))).cast("array<string>"))
    return spark.read.text(path).where("value <> ''").select(checked.alias("p")).select(F.col("p")[0].alias("qid"), F.col("p")[1].alias("text"))


def read_qrels(spark: SparkSession, path: str, judged_only: bool = False) -> DataFrame:
    """qrels(qid, docno, rel) of lines ``qid iteration docno rel``; ``judged_only`` leaves out grade 0."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("qid"), p[2].alias("docno"), p[3].cast("int").alias("rel"))
    return rows.where("rel <> 0") if judged_only else rows


def read_priors(spark: SparkSession, path: str) -> DataFrame:
    """priors(did, prior) of a CSV file with a header."""
    return spark.read.csv(path, header=True, schema="did string, prior double")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """run(qid, docno, rank, score, tag, postings_cost) of space-separated lines."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(
        p[0].alias("qid"), p[2].alias("docno"), p[3].cast("long").alias("rank"), p[4].cast("double").alias("score"), p[5].alias("tag"), F.try_element_at(p, F.lit(7)).cast("long").alias("postings_cost")
    )


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """ngrams(term): the second column of a CSV file without a header, each once."""
    return spark.read.csv(path, schema="id string, term string, frequency string").select(F.trim("term").alias("term")).where("term <> ''").distinct()


def read_evaluations(spark: SparkSession, *paths: str) -> DataFrame:
    """lines(path, value) of evaluation texts, for ``parse_evaluations``."""
    return spark.read.text(list(paths), recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
