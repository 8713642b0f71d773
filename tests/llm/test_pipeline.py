"""The pipeline against its stages done one by one, and the registration of all queries."""

import corpus_pipeline

import cases
from quern.llm import language_id, mixing, pieces, queries
from test_duplicates import near

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    lang = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    left = [r for i, r in rows.items() if lang[i].lang_pred != "und" and lang[i].score >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    best = {}
    for r in left:
        k = b"".join((r[1] or "").encode().split())
        if k not in best or (-len(r[1] or ""), r[0]) < (-len(best[k][1] or ""), best[k][0]):
            best[k] = r
    left = list(best.values())
    verdict = near(left, 80, 100)
    left = [r for r in left if verdict[r[0]][2]]
    mixed = mixing.mix(spark.createDataFrame(left, docs.schema)).select("doc_id", "text").collect()
    machine = pieces.Transducer(pieces.model_bytes(pieces.MODEL))
    want = sorted((r.doc_id, machine.encode(r.text)) for r in mixed)
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, list(r.ids)) for r in got.collect()) == want
    assert all(r.round_trip for r in got.collect())


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    kept = corpus_pipeline.identify_language(spark, docs, SF).count()
    assert kept >= 0.98 * docs.where("text rlike '\\\\p{L}'").count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "mixing", "sentencepiece"]


def test_stages_take_nulls_and_empty_tables(spark):
    for docs in (cases.frame(spark), cases.frame(spark, []), cases.frame(spark, [(None, None, None, None, None)] * 2)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= 2 * docs.count() + 60


def test_ten_queries_are_registered():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(known) and "pipeline" in known
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)
