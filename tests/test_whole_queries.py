"""Registered queries that once searched less than the whole passages."""

from quern.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_grouped_bm25_searches_whole_passages(spark, monkeypatch):
    search, seen = catalogue.rank.search, []
    monkeypatch.setattr(catalogue.rank, "search", lambda index, queries, *a, **k: seen.append(queries) or search(index, queries, *a, **k))
    assert catalogue.search_grouped_bm25(spark, SF).count() > 0
    assert sorted(seen[0].collect()) == sorted(catalogue.passages(spark, SF).collect())
