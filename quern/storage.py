"""Shared storage, staging, and numbering and summing of rows without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes a core below which ``spread`` deals rows out.
SMALL_BYTES = 16 << 20
#: Folders handed out by ``stage`` and not yet removed.
_staged: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors reach: under ``spark.checkpoint.dir``.

    Only on a local master a folder of our own may stand in for that setting, and is recorded in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the executors need a folder that all of them reach")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: its lineage ends there, a lost executor costs a re-read."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt to all cores, as one row group is one task however its file is cut. Other tables come as they are scanned.

    Small is what has less than SMALL_BYTES a core by the plan's own estimate, so what moves is bounded by the cluster, not by the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES * cores else df


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """What is staged inside the block is removed at its end: for blocks that write or collect their result."""
    mark = len(_staged)
    try:
        yield
    finally:
        while len(_staged) > mark:
            remove(spark, _staged.pop())


def number_rows(df: DataFrame, out: str, *order, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with ``out`` = 1, 2, ... in the given order.

    Rows are dealt by ranges of the order and numbered within their range; only the ranges' sizes, one row a
    partition, meet in one task. Staged between the two, as a second evaluation could cut other ranges.
    Ties get any order among themselves. ``then`` changes columns, not rows, of what is dealt: only its result is staged.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt if then is None else then(dealt)
    rows = stage(dealt.select("*", F.spark_partition_id().alias("__part"), local.alias("__at")), f"numbered-{out}")
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = rows.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    joined = rows.join(F.broadcast(offsets), "__part")
    return joined.withColumn(out, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def running_sum(df: DataFrame, value: str, out: str, *order: Column) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` up to the row in the given order, which has no ties.

    Rows are dealt by ranges of the order and summed within their range; one row a range meets in one task.
    """
    dealt = stage(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__part")), f"summed-{out}")
    before = F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = dealt.groupBy("__part").agg(F.sum(value).alias("__sum")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.sum(value).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn(out, own).join(F.broadcast(offsets), "__part").withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__before")


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file with ``text``, in place of an older one by one rename that readers see whole or not at all."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    target, fresh = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fresh.getFileSystem(spark._jsc.hadoopConfiguration()).create(fresh)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    options[0] = getattr(fs, "Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, target, options)


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a folder, if there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
