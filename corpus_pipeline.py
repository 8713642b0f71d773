"""Five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every result to the
shared folder and hands it on. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, language_id, minhash, mixing, pieces
from quern.storage import shared_dir, staging

#: Documents whose language has a smaller mean posterior are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.4


def staying(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (nulls match nulls), all columns kept. Rows of one id share its verdict."""
    return docs.join(ids.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognised language."""
    got = language_id.identify(docs, language_id.train(docs))
    return staying(docs, got.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the least doc_id."""
    return staying(docs, exact_dedup.exact_dedup(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at five-word similarity 0.8 or more the least doc_id stays."""
    return staying(docs, minhash.near_duplicates(docs, (80, 100)).where("kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at equal weight, as many rows as before on average, in random order."""
    return mixing.mix(docs).drop("copy", "copies", "shuffle_key")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The first and third stage are no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        with staging(spark):  # what the stage staged on its way goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
