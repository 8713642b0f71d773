"""Stop words are a parameter: none, Spark's own English list, a file of words, or words themselves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Lists go into the plan as a literal set; longer ones are refused.
MOST_WORDS = 100_000


def stop_words(spark: SparkSession, spec: str | Iterable[str] | None = "none") -> list[str]:
    """The sorted words of ``spec``: None or "none"; "english", the list that Spark ships; a path; or the words.

    A file holds words between commas or on lines of their own.
    """
    if spec is None or spec == "none":
        return []
    if spec == "english":
        return sorted(StopWordsRemover.loadDefaultStopWords("english"))
    if not isinstance(spec, str):
        return sorted({w for w in spec if w})
    words = spark.read.text(spec).select(F.explode(F.split("value", ",")).alias("w")).select(F.trim("w").alias("w")).where("w <> ''").distinct()
    rows = words.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} stop words in {spec}")
    return sorted(r.w for r in rows)
