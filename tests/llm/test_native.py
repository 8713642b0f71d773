"""Sharding, exact dedup, mixing: against SQL, and their edge cases."""

import pytest
from pyspark.sql import functions as F

import cases
from quern.llm import exact_dedup, mixing, sharding
from quern.llm.common import connected_components


def test_exact_dedup_equals_sql(spark, tmp_path):
    rows = cases.documents()
    want = cases.sql(exact_dedup.OP3_SQL, tmp_path, documents=(rows, cases.DOCUMENTS))
    assert cases.rows_of(exact_dedup.exact_dedup(cases.frame(spark, rows, clash=True))) == want


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(cases.frame(spark, [])).count() == 0
    rows = [(None, "a b", "", "", 1), (3, "ab", "", "", 1), (None, None, "", "", 1), (4, "", "", "", 1), (7, "z", "", "", 1), (7, "z", "", "", 1)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(cases.frame(spark, rows)).collect()}
    # the longer original stays even without an id; of equal length an id goes before none; repeated rows share the verdict
    assert got == {(None, None, 2, True), (3, None, 2, False), (None, 4, 2, False), (4, 4, 2, True), (7, 7, 2, True)}


def test_runs_are_sorted_and_filters_miss_none(spark):
    index = exact_dedup.MergeIndex(spark)
    index.add(cases.frame(spark))
    assert index.rows().count() == len(cases.documents()) and len(index.manifest["runs"]) == 1
    run = index.manifest["runs"][0]
    for path in (*index.manifest["rows"], f"{run['path']}/entries"):
        files = spark.read.parquet(path)
        for f in {r.f for r in files.select("_metadata.file_path").toDF("f").collect()}:
            d = [r.digest for r in spark.read.parquet(f).collect()]
            assert d == sorted(d)
    own = index.run(run)
    assert index.probe(own, run).count() == own.count() == run["entries"]
    other = own.withColumn("digest", own.digest + 1).select("digest", "sha")
    assert index.probe(other, run).count() == 0


@pytest.mark.parametrize("fanout", [2, 4])
def test_exact_dedup_by_arrivals(spark, tmp_path, monkeypatch, fanout):
    """Batch after batch, also under a reopened index, gives what one load gives; full tiers are merged."""
    monkeypatch.setattr(exact_dedup, "FANOUT", fanout)
    rows = cases.documents() + [(200 + i, f"late {i % 4}", "en", "s", 1) for i in range(30)]
    want = cases.rows_of(exact_dedup.exact_dedup(cases.frame(spark, rows)))
    root = f"file://{tmp_path}/index"
    for k in range(5):
        exact_dedup.MergeIndex(spark, root).add(cases.frame(spark, rows[k::5]))
    index = exact_dedup.MergeIndex(spark, root)
    assert cases.rows_of(index.verdicts(cases.frame(spark, rows))) == want
    tiers = sorted(r["tier"] for r in index.manifest["runs"])
    assert tiers == ([1, 3] if fanout == 2 else [1, 2]) and sum(r["rows"] for r in index.manifest["runs"]) == len(rows)


def sharded(shards):
    return cases.rows_of(shards.read()), {r.file: r for r in shards.manifest().collect()}


def test_sharding_query_equals_sql(spark, tmp_path):
    rows = cases.documents()
    cases.frame(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = cases.rows_of(sharding.op1_sharding(spark, f"file://{tmp_path}"))
    assert got == cases.sql(sharding.OP1_SQL, tmp_path / "documents.parquet", documents=(rows, cases.DOCUMENTS))


def test_appends_are_compacted_with_earlier_shards(spark):
    """Versions follow each other; small shards of several batches become few, of the target's size; old versions stay readable."""
    shards = sharding.Shards(spark, target_bytes=6000)
    rows, seen = [], []
    for k in range(6):
        batch = [(hash((k, i)) % (1 << 60), f"{k:02}{i:03}" * 20, "en", "s", 1) for i in range(10)]
        rows += batch
        shards.append(cases.frame(spark, batch, parts=2))
        seen.append((shards.version(), len(rows)))
        assert shards.compact().first().version == shards.version()
    got, live = sharded(shards)
    assert got == cases.rows_of(cases.frame(spark, rows))
    assert shards.version() > 6 and len(live) < 12 and max(r.bytes for r in live.values()) <= 6000 + 1000
    assert [shards.read(v).count() for v, _ in seen] == [n for _, n in seen]
    assert shards.expire() > 0 and sharded(shards)[0] == got


def test_sharding_needs_no_dense_ids(spark):
    rows = [(hash(("id", i)) % (1 << 62), f"text {i}", "en", "s", 1) for i in range(300)]
    shards = sharding.size_tiered(cases.frame(spark, rows, parts=8))
    assert [r.rows for r in shards.manifest().collect()] == [300] and shards.version() == 2


def test_sharding_splits_a_shard_over_the_target(spark):
    rows = [(i, f"{i:04}" * 750, "en", "s", 1) for i in range(40)]
    shards = sharding.size_tiered(cases.frame(spark, rows, parts=1), target_bytes=30000)
    live = shards.manifest().collect()
    assert sum(r.rows for r in live) == 40 and len(live) == 4 and cases.rows_of(shards.read()) == cases.rows_of(cases.frame(spark, rows))


def test_commit_is_once_and_whole(spark, monkeypatch):
    shards = sharding.Shards(spark, target_bytes=5000)
    shards.append(cases.frame(spark, parts=8))
    with pytest.raises(Exception, match="exist"):
        shards.commit(shards.manifest(), 1)
    stored = sharding.Shards.stored
    monkeypatch.setattr(sharding.Shards, "stored", lambda self, files: stored(self, files).where("doc_id <> 3"))
    with pytest.raises(RuntimeError, match="planned"):
        shards.compact()
    assert shards.version() == 1
    # texts of two rows swapped: rows and bytes agree, the stored hashes do not
    swapped = lambda self, files: stored(self, files).withColumn("text", F.reverse("text"))
    monkeypatch.setattr(sharding.Shards, "stored", swapped)
    with pytest.raises(Exception, match="differs"):
        shards.compact()
    assert shards.version() == 1


def test_sharding_edges(spark):
    shards = sharding.size_tiered(cases.frame(spark, []))
    assert shards.read().count() == 0 and shards.manifest().count() == 0
    rows = [(None, None, None, None, None), (None, "a", "", "", 1), (1, "", "", "", 0), (1, "", "", "", 0), (2, "long " * 100000, "", "", 1)]
    docs = cases.frame(spark, rows, clash=True).withColumn("row_hash", F.lit(1)).withColumn("text_bytes", F.lit(1)).withColumn("pack", F.lit("x"))
    shards = sharding.size_tiered(docs)
    assert cases.rows_of(shards.read()) == cases.rows_of(docs.drop("row_hash", "text_bytes"))
    with pytest.raises(ValueError, match="columns"):
        shards.append(cases.frame(spark))


def test_mixing_equals_sql(spark, tmp_path):
    rows = cases.documents() + [(1000 + i, f"t{i}", "en", "big", 1) for i in range(300)]
    want = cases.sql(mixing.OP5_SQL, tmp_path, documents=(rows, cases.DOCUMENTS))
    got = mixing.mix(cases.frame(spark, rows), keep=("doc_id", "source", "text"))
    assert cases.rows_of(got) == want


def test_mixing_reaches_its_weights(spark):
    rows = [(i, "t", "en", "a" if i < 3000 else "b", 1) for i in range(4000)]
    got = mixing.mix(cases.frame(spark, rows), {"a": 1, "b": 3}, size=8000).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in got}
    assert abs(n["a"] - 2000) < 5 * 2000**0.5 and abs(n["b"] - 6000) < 5 * 6000**0.5
    # a mean far above one draw's table
    one = mixing.mix(cases.frame(spark, rows[:1]), {"a": 1}, size=500).collect()
    assert 380 < len(one) < 620 and {r.copy for r in one} == set(range(1, len(one) + 1))


def test_mixing_edges(spark):
    assert mixing.mix(cases.frame(spark, [])).count() == 0
    rows = cases.documents()
    got = mixing.mix(cases.frame(spark, rows, clash=True), {None: 1.0, "s0": 0.0})
    assert {r.source for r in got.collect()} <= {None} and got.columns.count("copies") == 1
    a = mixing.mix(cases.frame(spark, [(None, "x", "en", "s", 1)] * 2 + [(5, "y", "en", "s", 1)] * 2), size=40).groupBy("doc_id", "copy").count().collect()
    assert all(r["count"] == 2 for r in a)  # repeated rows draw alike
    texts = {1: None, 2: "", 3: "long " * 200000}
    b = mixing.mix(cases.frame(spark, [(i, t, "en", None, None) for i, t in texts.items()]), size=60).collect()
    assert len(b) > 20 and all(r.text == texts[r.doc_id] for r in b)


def test_components(spark):
    import random

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7)]
    want = cases.components({x for e in edges if e[0] != e[1] for x in e}, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_least_hashed(spark):
    from quern.llm.common import least_hashed

    rows = [(i, "a") for i in range(5000)] + [(i, "b") for i in range(7)] + [(i % 3, "c") for i in range(4000)]
    df = spark.createDataFrame(rows, "key long, cls string").withColumn("bytes", F.lit(10))
    limits, counts = {"a": 20, "b": 20, "c": 10}, {"a": 5000, "b": 7, "c": 4000}
    got = least_hashed(df, limits, counts, 1 << 20)
    h = sorted((r.h, r.id) for r in spark.range(5000).select(F.xxhash64("id").alias("h"), "id").collect())
    assert sorted(i for i, y in got if y == "a") == sorted(i for _, i in h[:20])
    assert sum(y == "b" for _, y in got) == 7 and sum(y == "c" for _, y in got) == 10
    assert least_hashed(df.where("false"), {}, {}, 1) == []
    # a class has a third of the bytes; what would go beyond is passed over
    df = df.withColumn("bytes", F.when(F.col("key") == h[0][1], 1000).otherwise(10))
    few = [i for i, y in least_hashed(df, limits, counts, 3 * 100) if y == "a"]
    assert few == [i for _, i in h[1:11]]
