"""Substring dedup, MinHash and embedding near-dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

import cases
from quern.llm import embedding_dedup, minhash, substring_dedup


def kept_words(rows, window=20):
    """(words, removed places) by id, straight from the rule."""
    texts = {i: (t or "").encode().split() for i, t, *_ in rows}
    first, out = {}, {}
    for i in sorted(texts):
        w = texts[i]
        gone = set()
        for a in range(len(w) - window + 1):
            if first.setdefault(tuple(w[a : a + window]), (i, a)) != (i, a):
                gone.update(range(a, a + window))
        out[i] = (w, gone)
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)  # 1: every repeated minimiser is split by window
    rows = cases.documents()
    want = {i: (len(w), len(g), b" ".join(x for k, x in enumerate(w) if k not in g).decode()) for i, (w, g) in kept_words(rows).items()}
    got = substring_dedup.remove_repeats(cases.frame(spark, rows, clash=True)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == want and len(got) == len(rows)


def test_substring_dedup_query(spark, tmp_path):
    rows = cases.documents(4)
    cases.frame(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = cases.rows_of(substring_dedup.op7_substring_dedup(spark, f"file://{tmp_path}"))
    want = [{"doc_id": i, "n_words": len(w), "n_removed": len(g), "kept_sha256": hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in g)).hexdigest()} for i, (w, g) in kept_words(rows).items()]
    assert got == sorted(want, key=cases.repr_sorted)


def test_substring_dedup_edges(spark):
    assert substring_dedup.remove_repeats(cases.frame(spark, [])).count() == 0
    t = " ".join(f"w{i}" for i in range(25))
    got = substring_dedup.remove_repeats(cases.frame(spark, [(None, t, "", "", 1), (2, t, "", "", 1), (3, None, "", "", 1)])).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(None, 0), (2, 25), (3, 0)}
    again = substring_dedup.remove_repeats(cases.frame(spark, [(5, t, "", "", 1), (5, t, "", "", 1)])).collect()
    assert [r.n_removed for r in again] == [0, 0]


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup_goes_by_row(spark, monkeypatch, hot):
    """Several rows without an id, and rows of one id with different texts, are documents of their own."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(11)
    shared = [cases.words(rng, 40, 10**6) for _ in range(3)]
    rows = []
    for i in (None, None, None, 7, 7, 3, 9):
        w = cases.words(rng, 60, 10**6)
        for s in rng.sample(shared, 2):
            at = rng.randrange(len(w))
            w = w[:at] + s + w[at:]
        rows.append((i, " ".join(w), "", "", 1))
    h = {r.text: r.h for r in cases.frame(spark, rows).selectExpr("text", "xxhash64(CAST(text AS BINARY)) AS h").collect()}
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], h[r[1]]))
    want = kept_words([(k, r[1]) for k, r in enumerate(ordered)])
    got = {r.text: (r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(cases.frame(spark, rows)).collect()}
    for k, (w, gone) in want.items():
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
        assert got[kept] == (ordered[k][0], len(gone))
    assert sum(n for _, n in got.values()) == sum(len(g) for _, g in want.values()) >= 7 * 40


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows, top, of):
    s = {i: shingles(t) for i, t, *_ in rows}
    ids = sorted(s)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and of * len(s[a] & s[b]) >= top * len(s[a] | s[b])]
    c = cases.components(ids, edges)
    return {i: (len(s[i]), c[i], c[i] == i) for i in ids}


@pytest.mark.parametrize("threshold", [(80, 100), (85, 100)])
def test_minhash(spark, threshold):
    rows = cases.documents(2)
    got = minhash.near_duplicates(cases.frame(spark, rows, clash=True), threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == near(rows, *threshold) and len(got) == len(rows)


def test_minhash_in_small_cells(spark, monkeypatch):
    """A group dealt out over many cells gives the same components."""
    monkeypatch.setattr(minhash, "CELL_MEMBERS", 4)
    monkeypatch.setattr(minhash, "CELL_BYTES", 4000)
    rng = random.Random(5)
    base = cases.words(rng, 150)
    rows = []
    for i in range(60):
        t = base[:]
        t[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(t), "", "", 1))
    got = minhash.near_duplicates(cases.frame(spark, rows), (85, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == near(rows, 85, 100)


def test_minhash_edges(spark):
    assert minhash.near_duplicates(cases.frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f g", "", "", 1), (2, "a b c d e f g", "", "", 1), (3, None, "", "", 1), (4, " ", "", "", 1), (5, "a b", "", "", 1), (6, "A  B", "", "", 1), (6, "A  B", "", "", 1)]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(cases.frame(spark, rows)).collect()}
    assert got == {(None, 3, None, True), (2, 3, None, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)}


def test_posterior_bounds_miss_little():
    """A pair at the threshold is pruned with a chance near the chosen one, and a distant pair early."""
    least = minhash.least_matches(0.85)
    rng = np.random.default_rng(0)
    pruned = 0
    for _ in range(4000):
        hits = rng.random(minhash.HASHES) < 0.85
        pruned += any(hits[:n].sum() < m for n, m in least.items())
    assert pruned <= 8
    assert least[minhash.BATCH] > 0.3 * minhash.BATCH


def test_exact_sets_agree_with_sets():
    rng = random.Random(9)
    docs = [[b"%d" % rng.randrange(6) for _ in range(n)] for n in (0, 1, 2, 4, 4, 5, 9, 30, 60)] + [[b"1"], [b"1", b"1"]]
    sets = minhash.exact_sets(docs)
    plain = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in docs]
    for a, x in zip(sets, plain, strict=True):
        for b, y in zip(sets, plain, strict=True):
            assert len(np.intersect1d(a, b)) == len(x & y)


def vectors(n=300, dim=16):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, dim))
    for i in range(100, n):
        x[i] = x[i % 25] * rng.uniform(0.5, 4) + rng.normal(size=dim) * rng.choice((0.05, 0.15, 0.3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] * dim), (n + 3, [1.0] * 3), (n + 4, []), (n + 5, [1.0, None] + [0.5] * (dim - 2)), (n + 6, [float("inf")] * dim)]


def linked(rows, threshold=0.95):
    u = {i: embedding_dedup.unit(v) for i, v in rows}
    ids = sorted(u)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= threshold]
    return ids, edges


def test_embeddings(spark):
    rows = vectors()
    ids, edges = linked(rows)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    assert set(got) == set(ids)
    found = sum(r.n_links for r in got.values())
    assert 0.9 * 2 * len(edges) <= found <= 2 * len(edges) and len(edges) > 500
    c = cases.components(ids, edges)
    assert all(got[i].component_id >= c[i] and got[i].kept == (got[i].component_id == i) for i in ids)
    assert sum(got[i].component_id == c[i] for i in ids) >= 0.95 * len(ids)


def test_embeddings_in_small_cells(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = cases.rows_of(embedding_dedup.near_vectors(df))
    monkeypatch.setattr(embedding_dedup, "CELL_MEMBERS", 7)
    assert cases.rows_of(embedding_dedup.near_vectors(df)) == want


def test_embeddings_edges(spark):
    schema = "vec_id long, embedding array<float>, member int, id int, near int"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, 1, 1, 1), (4, v, 1, 1, 1), (5, [2.0, 4.0, 6.0], 1, 1, 1), (5, v, 1, 1, 1), (9, [-1.0, 0.0, 0.0], 1, 1, 1)]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(None, 3, None, True), (4, 3, None, False), (5, 3, None, False), (9, 0, 9, True)}
