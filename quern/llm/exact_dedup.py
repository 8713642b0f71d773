"""Exact dedup: a log-structured merge index over digests, DataFrame operations only.

Memtables are the scan tasks: each flushes its rows (doc_id, digest, SHA-256, length), sorted by digest, into one of
FANOUT level-0 runs. The runs of a load are merged into one run of the first tier: per digest the number of entries and the row
that stays. Every merged run has a bit filter of its digests. The next arrivals probe the filters of all older runs, so
only digests that a run may hold are joined with it. FANOUT runs of one tier are merged into one of the next; compaction adds
up the entries and keeps the row that stays, the smallest identifier among equals. A manifest, replaced by one rename,
names the runs that count.

Digests with more than one entry are hits. A bit filter of the hits lets a second scan pick the texts to compare
byte for byte. Equal texts are combined inside each task before the shuffle, so a group that holds a third of the table sends
one text per task; the few hits that many rows share are broadcast to the rows.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, replace_text
from .common import SPACE, bit_rows, joined_by_size, probed, remove, shared_dir, stage

#: Runs of a tier that are merged into one, and level-0 runs of a load.
FANOUT = 4
#: Bits of the hit filter, which is broadcast: 16 per hit, between these powers of two (16 MB at most). A run's own
#: filter has 16 bits for every digest; it is a table, broadcast up to the same size and joined beyond.
FILTER_BITS = (15, 27)
ROWS = "doc_id long, digest long, sha binary, chars int, run int"
RUN = "digest long, sha binary, n long, chars int, doc_id long"


def normalised(text):
    """The text without the six separators; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def filter_power(keys: int) -> int:
    return max(FILTER_BITS[0], (16 * max(1, keys)).bit_length())


def merged(entries: DataFrame) -> DataFrame:
    """RUN of entries of several runs: counts add up; the longest original text stays, then the smallest id."""
    best = F.max(F.struct(F.col("chars"), F.bitwise_not(F.col("doc_id")).alias("inv"))).alias("best")
    return entries.groupBy("digest", "sha").agg(F.sum("n").alias("n"), best).select("digest", "sha", "n", "best.chars", F.bitwise_not(F.col("best.inv")).alias("doc_id"))


class MergeIndex:
    """A log-structured merge index in a folder; an index that is there already is carried on."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, (root or shared_dir(spark, "merge-index")).rstrip("/")
        at = f"{self.root}/MANIFEST"
        #: runs: path, tier, entries and the rows they stand for; rows and hits: folders of every load.
        self.manifest = json.loads(spark.read.text(at).first()[0]) if exists(spark, at) else {"runs": [], "rows": [], "hits": []}

    def publish(self, manifest: dict) -> None:
        replace_text(self.spark, f"{self.root}/MANIFEST", json.dumps(manifest))
        self.manifest = manifest

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def flush(self, docs: DataFrame, id_col: str, text_col: str) -> str:
        """Write the sorted level-0 runs of a load in one scan; return their folder."""
        path = self.folder("level0")
        norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"))
        rows = norm.select("doc_id", F.xxhash64("norm").alias("digest"), F.unhex(F.sha2("norm", 256)).alias("sha"), "chars", (F.spark_partition_id() % FANOUT).alias("run"))
        rows.sortWithinPartitions("run", "digest").write.partitionBy("run").parquet(path)
        return path

    def rows(self) -> DataFrame:
        """ROWS of all loads."""
        return reduce(DataFrame.unionByName, (self.spark.read.schema(ROWS).parquet(p) for p in self.manifest["rows"]))

    def run(self, run: dict) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{run['path']}/entries")

    def merge(self, entries: DataFrame, tier: int) -> dict:
        """Write one run of ``tier``, sorted within its files, and its filter."""
        path = self.folder(f"tier{tier}")
        merged(entries).sortWithinPartitions("digest").write.parquet(f"{path}/entries")
        run = {"path": path, "tier": tier}
        run["entries"], run["rows"] = self.run(run).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        bit_rows(self.run(run).select("digest"), "digest", filter_power(run["entries"])).write.parquet(f"{path}/filter")
        return run

    def probe(self, arrivals: DataFrame, run: dict) -> DataFrame:
        """(digest, sha) of the arrivals that an older run holds; only those that pass its filter are joined with it."""
        power = filter_power(run["entries"])
        bits = self.spark.read.schema("bucket long, bits binary").parquet(f"{run['path']}/filter")
        maybe = probed(arrivals.select("digest", "sha"), "digest", F.broadcast(bits) if power <= FILTER_BITS[1] else bits, power)
        return maybe.join(self.run(run).select("digest", "sha"), ["digest", "sha"], "left_semi")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """One load: flush, merge its runs, probe the older ones, compact tiers that are full, publish."""
        level0 = self.flush(docs, id_col, text_col)
        rows = self.spark.read.schema(ROWS).parquet(level0)
        new = self.merge(rows.select("digest", "sha", F.lit(1).cast("long").alias("n"), "chars", "doc_id"), 1)
        own = self.run(new)
        found = [own.where("n > 1").select("digest", "sha")] + [self.probe(own, r) for r in self.manifest["runs"]]
        hits = self.folder("hits")
        reduce(DataFrame.unionByName, found).write.parquet(hits)
        runs, dead, tier = [*self.manifest["runs"], new], [], 1
        while len(full := [r for r in runs if r["tier"] == tier]) >= FANOUT:
            runs = [r for r in runs if r["tier"] != tier] + [self.merge(reduce(DataFrame.unionByName, map(self.run, full)), tier + 1)]
            dead += full
            tier += 1
        self.publish({"runs": runs, "rows": [*self.manifest["rows"], level0], "hits": [*self.manifest["hits"], hits]})
        for r in dead:
            remove(self.spark, r["path"])

    def hits(self) -> DataFrame:
        """(digest, sha, n, keep_id) of the digests with several entries, over all runs."""
        runs = [self.run(r) for r in self.manifest["runs"]]
        if len(runs) == 1:
            entries = runs[0].where("n > 1")
        else:
            marked = reduce(DataFrame.unionByName, (self.spark.read.schema("digest long, sha binary").parquet(p) for p in self.manifest["hits"])).distinct()
            entries = merged(reduce(DataFrame.unionByName, runs).join(marked, ["digest", "sha"], "left_semi"))
        return stage(entries.select("digest", "sha", "n", F.col("doc_id").alias("keep_id")), "hits")

    def verdicts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The result of ``exact_dedup`` for all loads, given their documents."""
        hits = self.hits()
        check = verified(docs, hits, id_col, text_col)
        sure = (F.col("texts") == 1) & (F.col("rows") == F.col("n"))
        n = F.when(sure, F.col("n")).otherwise(F.raise_error(F.lit("different bytes under one digest")).cast("long"))
        same = stage(hits.join(check, ["digest", "sha"]).select("digest", "sha", "keep_id", n.alias("n")), "same")
        out = joined_by_size(self.rows().drop("run"), same, ["digest", "sha"], "n", sum(r["rows"] for r in self.manifest["runs"]))
        keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
        return out.select(
            "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
            F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
        )


def verified(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, sha, texts, rows): how many different byte strings, of how many rows, stand behind each hit."""
    power = min(FILTER_BITS[1], filter_power(hits.count()))
    norm = docs.select(normalised(F.col(text_col)).alias("norm")).select("norm", F.xxhash64("norm").alias("digest"))
    maybe = probed(norm, "digest", F.broadcast(bit_rows(hits, "digest", power)), power)
    distinct = maybe.groupBy("digest", "norm").agg(F.count("*").alias("rows"))
    return distinct.groupBy("digest", F.unhex(F.sha2("norm", 256)).alias("sha")).agg(F.count("*").alias("texts"), F.sum("rows").alias("rows"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal without separators; null and empty texts form one group; very long texts are
    compared whole. The longest original text (code points) stays, then the least doc_id; a null doc_id stays only in a group of
    nulls. Rows that repeat a doc_id within a group share its ``kept``. An empty table gives an
    empty result; other columns are neither read nor returned. Different bytes
    under one SHA-256 would end the job with an error instead of a wrong merge.
    """
    index = MergeIndex(docs.sparkSession)
    index.add(docs, id_col, text_col)
    return index.verdicts(docs, id_col, text_col)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', '', 'g')) AS sha
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY sha) AS n
  FROM d)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM w
"""
