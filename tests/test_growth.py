"""What moves, and what is worked out again, as tables grow."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.index import build_fielded_index, build_index, number_documents, regex_counts
from quern.operators import experiments, rank, reindex
from quern.sources import ciff
from tests.test_text import greedy


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_many_terms_are_sent_or_joined(spark, monkeypatch, most):
    monkeypatch.setattr(text, "PATTERN_TERMS", 3)
    monkeypatch.setattr(text, "SENT_BYTES", most)
    rng = random.Random(3)
    vocabulary = ["a", "b c", "𝒳b", "abcabc", "abc abc", "ab", "abcab", "c", "ca b", ""]
    rows = [(i, "".join(rng.choice("abcx 𝒳") for _ in range(40))) for i in range(20)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    found = text.longest_match(df, "id", "t", spark.createDataFrame([(v,) for v in vocabulary], "term string"))
    assert {r.id: r.tokens for r in found.collect()} == {i: greedy(t or "", vocabulary) for i, t in rows}
    assert (exchanges(found) == 0) == (most > 0)  # texts stay where they are


def test_words_of_a_row_are_counted_where_it_is(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["", "é", "é", "é"])]
    got = text.word_counts(spark.createDataFrame(rows, "id long, w array<string>").coalesce(1), F.col("w")).select("id", "terms")
    assert {r.id: {x.term: x.tf for x in r.terms} for r in got.collect()} == {1: {"a": 1, "b": 2}, 2: {}, 3: {}, 4: {"": 1, "é": 3}}
    assert exchanges(got) == 0


def collection(spark, n=60, names=lambda i: f"d{i:03}"):
    rng = random.Random(5)
    rows = [(names(i), " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randrange(0, 12))), rng.choice(("aa", "bb cc", ""))) for i in range(n)]
    queries = [(i, " ".join(rng.choice("abcdefghijz") * 2 for _ in range(5))) for i in range(12)] + [(90, "zz"), (91, "")]
    return spark.createDataFrame(rows, "did string, body string, title string"), spark.createDataFrame(queries, "qid long, text string")


def same(index, queries, model, **params):
    terms = rank.asked_terms(index, queries)
    key = lambda df: {(r.qid, r.rank): (r.docid, r.name, r.score if r.score is None else repr(round(r.score, 8))) for r in df.collect()}
    got = rank.best_documents(index, queries, terms, model, 7, **params)
    want = key(rank.top_k(rank.score(index, queries, model, terms=terms, **params), 7))
    assert key(got) == want and want
    return got._jdf.queryExecution().executedPlan().toString()


def test_best_documents_equal_the_general_ranking(spark, monkeypatch):
    monkeypatch.setattr(rank, "CELLS", 40)  # many blocks and prunings
    corpus, queries = collection(spark)
    index = build_index(corpus.withColumnRenamed("body", "content")).staged()
    plan = same(index, queries, "lm")
    assert "MapInArrow" in plan and "hashpartitioning(qid" in plan and ", name#" not in plan.split("MapInArrow")[0].split("hashpartitioning")[1].split(")")[0]
    same(index, queries, "bm25")
    same(index, queries, "lm", conjunctive=True)
    same(reindex.fitted(reindex.with_priors(index, init="len"), "prior", total=5).staged(), queries, "lm_fitted_prior")
    same(reindex.grouped(index, "porter").staged(), queries, "bm25")
    some = index.docs.select(F.col("name").alias("did"), (F.col("docid") % 4 - 1.0).alias("prior")).where("prior < 2")
    same(reindex.with_priors(index, some), queries, "lm_prior")  # NaN, minus infinity, numbers and null


def test_best_documents_of_fields_and_of_one_name(spark):
    corpus, queries = collection(spark)
    index = build_fielded_index(corpus, ("title", "body")).staged()
    for fields in (None, ["body"], ["title"]):
        same(index, queries, "lm", fields=fields)
    corpus, queries = collection(spark, names=lambda i: f"d{i // 2}")
    same(build_index(corpus.withColumnRenamed("body", "content")).staged(), queries, "lm")
    assert "MapInArrow" in same(build_index(corpus.withColumnRenamed("body", "content")).staged(), queries, "bm25")


def test_words_are_counted_without_moving_them(spark):
    corpus, _ = collection(spark)
    counts = regex_counts(number_documents(corpus.withColumnRenamed("body", "content")))
    assert "hashpartitioning(docid" not in counts._jdf.queryExecution().executedPlan().toString()
    fielded = build_fielded_index(corpus.withColumnRenamed("title", "terms"), ("terms", "body"), stopwords=["aa"])
    df = {r.term: r.df for r in fielded.dict.collect()}
    rows = [set((r.terms + " " + r.body).split()) - {"aa"} for r in corpus.withColumnRenamed("title", "terms").collect()]
    assert df == {w: sum(w in r for r in rows) for w in set().union(*rows)}


def test_postings_are_coded_as_a_whole():
    rng = random.Random(7)
    pairs = [(rng.choice((1, 127, 128, 300, 2**20, 2**40)), rng.choice((1, 5, 127, 128, 70_000))) for _ in range(200)]
    for cut in (pairs, pairs[:3], [(0, 4), *pairs], []):  # a gap of 0 is left out of its message
        gaps, tfs = (np.array([p[i] for p in cut], np.int64) for i in (0, 1))
        data, starts = ciff.encoded_pairs(gaps, tfs)
        whole = ciff.message((1, 'wörd"'), (2, 2), (3, 5)) + data.tobytes()
        assert whole == ciff.postings_list('wörd"', 2, 5, cut) and len(starts) == len(cut) + 1 and starts[-1] == len(data)
        term, df, cf, docids, got = ciff.decoded(whole)
        assert (term, df, cf, list(docids), list(got)) == ciff.parse_postings(whole)


def test_interchange_is_encoded_by_all_tasks_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ciff, "BLOB_BYTES", 100)
    index = build_index(collection(spark)[0].withColumnRenamed("body", "content")).staged()
    stage, seen = ciff.stage, []
    monkeypatch.setattr(ciff, "stage", lambda df, name: seen.append(name) or stage(df, name))
    for name in ("x.ciff", "x.ciff.gz"):
        ciff.export_ciff(index, str(tmp_path / name), "x")
    assert "ciff-encoded" in seen
    with ciff.stream(str(tmp_path / "x.ciff.gz"), "rb") as f, open(tmp_path / "x.ciff", "rb") as g:
        frames = list(ciff._frames(f))
        assert frames == list(ciff._frames(g))
    terms = [ciff.parse_postings(x)[0] for x in frames[1 : 1 + index.dict.count()]]
    assert terms == sorted(terms) and len(frames) == 1 + len(terms) + index.docs.count()


def test_few_needles_are_searched_without_a_test_of_every_pair(spark):
    texts = spark.createDataFrame([(i, None if i == 9 else f"{i} ab ü𝒳 {i % 3}") for i in range(10)], "id long, text string")
    needles = spark.createDataFrame([("p", "𝒳 1"), ("q", "ab"), ("q", "b ü"), (None, "2 ab"), ("r", "")], "needle_id string, needle string")
    found = experiments.containments(texts, needles)
    want = [(i, n) for i in range(9) for n, x in (("p", "𝒳 1"), ("q", "ab"), ("q", "b ü"), (None, "2 ab")) if x in f"{i} ab ü𝒳 {i % 3}"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
