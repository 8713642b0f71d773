"""Sharding: size-tiered compaction with a versioned manifest, DataFrame operations only.

``append`` writes a batch of arrivals as small immutable shards: each scan task writes the rows it reads to one file, without
a shuffle. Every batch and every compaction has a folder of its own, and is published as the next version of the manifest,
which lists the live shards with their rows, bytes and checksum. ``compact`` sorts the live shards into tiers of similar
size (powers of four of their bytes), packs shards of a tier up to the target size, and rewrites those packs that are
full, or hold FANOUT shards; a shard over the target is split. Each pack is one task and one file. A later append is
compacted together with what earlier ones left. ``commit`` checks rows, bytes and checksums against the shards that went
in, and publishes by one rename that fails if the version exists. Planning windows run inside lanes of some thousand shards,
so none of them grows with the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from ..storage import exists, number_rows
from .common import remove, shared_dir, stage

FANOUT = 4
LANE = 1024  # shards
TARGET_BYTES = 32 << 20
OWN = ("text_bytes", "row_hash")
MANIFEST = "file string, rows long, bytes long, checksum long, tier int, version int"


def _checksum(columns: list[str]):
    return F.xxhash64(*(f"`{c}`" for c in columns))


def _files(spark: SparkSession, folder: str, pattern: str = ".parquet") -> bool:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(fs_path) and any(x.getPath().getName().endswith(pattern) for x in fs.listStatus(fs_path))


class Shards:
    """Shards and manifest in a folder; what is there already is carried on."""

    def __init__(self, spark: SparkSession, root: str | None = None, target_bytes: int = TARGET_BYTES) -> None:
        self.spark, self.root, self.target = spark, (root or shared_dir(spark, "shards")).rstrip("/"), target_bytes

    def at(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}"

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version, the last one by default: file, rows, bytes, checksum, tier, version."""
        return self.spark.read.schema(MANIFEST).parquet(self.at(version or self.version()))

    def schema(self) -> StructType:
        """Of the rows as stored: the columns of the first batch, then OWN."""
        return self.spark.read.parquet(f"{self.root}/schema").schema

    def stored(self, files: list[str]) -> DataFrame:
        """The rows of some shards. Their paths are metadata that planning a scan lists in any case."""
        read = self.spark.read.schema(self.schema())
        return read.parquet(*files) if files else self.spark.createDataFrame([], self.schema())

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version with the columns that they came with."""
        return self.stored([r.file for r in self.manifest(version).select("file").collect()]).drop(*OWN)

    def listed(self, folder: str) -> DataFrame:
        """(file, rows, bytes, checksum, tier) of the files in a folder, read back from them."""
        schema = self.schema()
        own = [f.name for f in schema if f.name not in OWN and not isinstance(f.dataType, MapType)]
        rows = self.spark.read.schema(schema).parquet(folder) if _files(self.spark, folder) else self.spark.createDataFrame([], schema).withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
        sound = F.when(_checksum(own) == F.col("row_hash"), F.col("row_hash")).otherwise(F.raise_error(F.lit("a row differs from what was appended")).cast("long"))
        files = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.sum("text_bytes").alias("bytes"), F.bit_xor(sound).alias("checksum"))
        return files.withColumn("tier", F.floor((F.length(F.bin("bytes")) - 1) / 2).cast("int"))

    def commit(self, live: DataFrame, version: int) -> DataFrame:
        """Publish the manifest ``version`` at once; raises if that version exists."""
        draft, final = f"{self.root}/manifest/draft-{uuid.uuid4().hex}", self.at(version)
        live.select("file", "rows", "bytes", "checksum", "tier", F.lit(version).alias("version")).write.parquet(draft)
        jvm = self.spark._jvm
        src, dst = jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(final)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(src, dst, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return self.manifest(version)

    def append(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Write the rows, all their columns, as immutable small shards and publish them as the next version."""
        version = self.version()
        own = [c for c in docs.columns if c.lower() not in OWN]
        hashed = [f.name for f in docs.schema if f.name in own and not isinstance(f.dataType, MapType)]
        rows = docs.select(
            *(f"`{c}`" for c in own), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("text_bytes"),
            _checksum(hashed).alias("row_hash"),
        )
        if not exists(self.spark, f"{self.root}/schema"):
            rows.limit(0).write.parquet(f"{self.root}/schema")
        elif rows.columns != self.schema().names:
            raise ValueError(f"columns {own} differ from those stored")
        folder = f"{self.root}/shards/batch-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        new = self.listed(folder)
        return self.commit(self.manifest(version).drop("version").unionByName(new) if version else new, version + 1)

    def plan(self) -> DataFrame:
        """(file, pack, parts, ...) of the live shards that are due: where each one goes."""
        live = self.manifest()
        lanes = max(1, live.count() // LANE)
        s = live.withColumn("lane", F.pmod(F.xxhash64("file"), F.lit(lanes)))
        s = s.withColumn("parts", F.ceil(F.col("bytes") / self.target).cast("int"))
        small = s.where("parts <= 1")
        before = F.sum("bytes").over(W.partitionBy("lane", "tier").orderBy("file").rowsBetween(W.unboundedPreceding, -1))
        small = small.withColumn("n", F.floor(F.coalesce(before, F.lit(0)) / self.target).cast("string"))
        small = small.withColumn("pack", F.concat_ws("-", F.col("lane").cast("string"), F.col("tier").cast("string"), "n")).drop("n")
        one = W.partitionBy("pack")
        due = (F.count("*").over(one) >= FANOUT) | ((F.count("*").over(one) > 1) & (F.sum("bytes").over(one) >= self.target // 2))
        small = small.withColumn("due", due).where("due").drop("due").withColumn("parts", F.lit(1))
        # a shard over the target is split, and shares its files with no other
        return small.unionByName(s.where("parts > 1").withColumn("pack", F.col("file")))

    def compact(self) -> DataFrame:
        """Rewrite the packs that are due and publish the result as the next version; nothing is written if none is."""
        version, planned = self.version(), stage(self.plan(), "shard-plan")
        files = [r.file for r in planned.select("file").collect()]
        if not files:
            return self.manifest()
        # every target file has a number, and is written by the task of that number
        targets = planned.select("pack", "parts").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        numbered = stage(number_rows(targets, "target", F.col("pack"), F.col("part")), "shard-targets")
        n = numbered.count()
        where = planned.select("file", "pack", "parts")
        rows = self.stored(files).withColumn("__file", F.col("_metadata.file_path")).join(where.withColumnRenamed("file", "__file"), "__file")
        part = F.pmod(F.shiftright("row_hash", 7), F.col("parts").cast("long")).cast("int")
        moved = rows.withColumn("part", part).join(numbered.select("pack", "part", "target"), ["pack", "part"])
        moved = moved.repartitionById(n, (F.col("target") - 1).cast("int")).select(*(f"`{c}`" for c in self.schema().names))
        folder = f"{self.root}/shards/merged-{uuid.uuid4().hex}"
        moved.write.option("compression", "zstd").parquet(folder)
        made = stage(self.listed(folder), "merged-shards")
        sums = F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.bit_xor("checksum"), F.lit(0))
        have, want = tuple(made.agg(*sums).first()), tuple(planned.agg(*sums).first())
        if have != want:
            raise RuntimeError(f"merged shards hold {have} rows, bytes and checksum, planned were {want}")
        kept = self.manifest(version).join(planned.select("file"), "file", "left_anti").drop("version")
        return self.commit(kept.unionByName(made), version + 1)

    def expire(self) -> int:
        """Remove the shards that only older versions list, and those versions; return the number of files."""
        last = self.version()
        old = [v for v in range(1, last) if exists(self.spark, self.at(v))]
        if not old:
            return 0
        dead = self.spark.read.schema(MANIFEST).parquet(*map(self.at, old)).select("file").distinct().join(self.manifest().select("file"), "file", "left_anti")
        files = [r.file for r in dead.collect()]
        for path in [*files, *map(self.at, old)]:
            remove(self.spark, path)
        return len(files)


def size_tiered(docs: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES, text_col: str = "text") -> Shards:
    """Append ``docs`` to the shards in ``root`` and compact them.

    Ids mean nothing here. Null texts count as empty and stay null in the shards; very long texts stay whole, in a shard that
    may be over the target by one text; repeated rows are all stored; shards of equal size and name order have no ties; an
    empty table commits an empty manifest. Columns of the input that are named like the operator's own (text_bytes,
    row_hash) are replaced. Later batches need the same columns.
    """
    shards = Shards(docs.sparkSession, root, target_bytes)
    shards.append(docs, text_col)
    shards.compact()
    return shards


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document as read back through the last manifest, with what that manifest says of all of them."""
    shards = size_tiered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    live = shards.manifest()
    totals = live.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("live_rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("live_bytes"))
    rows = shards.read().select("doc_id", "lang", "source", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"))
    return rows.crossJoin(F.broadcast(totals))  # one row


OP1_SQL = """
SELECT doc_id, lang, source, sha256(coalesce(text, '')) AS text_sha256, count(*) OVER () AS live_rows,
       CAST(sum(strlen(coalesce(text, ''))) OVER () AS BIGINT) AS live_bytes FROM documents
"""
