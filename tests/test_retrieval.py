"""Indexes, ranking, transforms, evaluation and interchange on small collections, by hand."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.index import build_index, load_index, number_documents
from quern.operators import evaluate, experiments, phrases, rank, reindex
from quern.sources import ciff, readers, writers
from quern.storage import number_rows


@pytest.fixture(scope="module")
def mini(spark):
    corpus, queries, qrels = readers.collection(spark, "mini")
    return build_index(corpus).staged(), queries, qrels


def tokens(s):
    return [w for w in "".join(c if c.isalpha() else " " for c in s.lower().replace("é", "e").replace("ï", "i")).split() if w]


def test_index_tables(spark, mini):
    index, _, _ = mini
    corpus = {r.did: r.content for r in readers.collection(spark, "mini")[0].collect()}
    docs = {r.docid: r for r in index.docs.collect()}
    assert [docs[i].name for i in range(1, 8)] == sorted(corpus)
    assert {r.name: r.len for r in docs.values()} == {n: len(tokens(t)) for n, t in corpus.items()}
    terms = {r.termid: r.term for r in index.dict.collect()}
    assert [terms[i] for i in sorted(terms)] == sorted({w for t in corpus.values() for w in tokens(t)})
    got = {(docs[r.docid].name, terms[r.termid]): r.tf for r in index.postings.collect()}
    assert got == {(n, w): c for n, t in corpus.items() for w, c in Counter(tokens(t)).items()}
    assert index.terms().count() == sum(got.values()) and index.about.num_docs == 7 and index.about.sumdf == len(got)


def test_lm_and_bm25_by_hand(mini):
    index, queries, _ = mini
    docs = {r.name: r.len for r in index.docs.collect()}
    df = {r.term: r.df for r in index.dict.collect()}
    s = index.about
    got = {(r.qid, r.docno): r for r in rank.search(index, queries, "lm").collect()}
    # document f holds coffee and trade once each
    want = math.log(docs["f"]) + sum(math.log(1 + 0.3 * s.sumdf / (0.7 * df[w] * docs["f"])) for w in ("coffee", "trade"))
    assert abs(got["1", "f"].score - want) < 1e-12 and got["1", "f"].postings_cost == df["coffee"] + df["trade"]
    b = {(r.qid, r.docno): r.score for r in rank.search(index, queries, "bm25").collect()}
    norm = 1.2 * (0.25 + 0.75 * docs["f"] / s.avgdl)
    assert abs(b["1", "f"] - sum(math.log10((7 - df[w] + 0.5) / (df[w] + 0.5) + 1) * 2.2 / (1 + norm) for w in ("coffee", "trade"))) < 1e-12


def test_batches_equal_single_queries_and_prefixes(spark, mini):
    index, queries, _ = mini
    whole = {(r.qid, r.rank): r.docno for r in rank.search(index, queries, "lm").collect()}
    for q in queries.collect():
        one = {(r.qid, r.rank): r.docno for r in rank.search(index, spark.createDataFrame([q], queries.schema), "lm", 2).collect()}
        assert one == {k: v for k, v in whole.items() if k[0] == q.qid and k[1] < 2}
    assert {r.qid for r in rank.search(index, queries, "lm", first=2, last=2).collect()} == {"2"}
    with pytest.raises(ValueError, match="unknown model"):
        rank.search(index, queries, "no")


def test_conjunctive_needs_every_token(spark, mini):
    index = mini[0]
    q = spark.createDataFrame([("1", "rail freight"), ("2", "rail zebra"), ("3", "rail.")], "qid string, text string")
    got = {(r.qid, r.name) for r in rank.score(index, q, conjunctive=True).collect()}
    assert got == {("1", "c")}  # an unknown word and the empty token after a full stop match nothing


def test_equal_documents_tie_by_id(spark):
    index = build_index(spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "two")], "did string, content string"))
    q = spark.createDataFrame([("1", "one two")], "qid string, text string")
    assert [r.docno for r in rank.search(index, q).orderBy("rank").collect()][:2] == ["a", "b"]


def test_empty_collection(spark):
    index = build_index(spark.createDataFrame([], "did string, content string"))
    assert index.docs.count() == index.postings.count() == index.dict.count() == 0 and index.about.num_docs == 0
    index = build_index(spark.createDataFrame([("a", ""), (None, "x"), ("b", None)], "did string, content string"))
    assert {(r.name, r.len) for r in index.docs.collect()} == {("a", 0), ("b", 0)}


def test_numbering_equals_a_sort(spark):
    rng = random.Random(1)
    xs = [(f"{rng.random():.9f}",) for _ in range(500)]
    got = number_rows(spark.createDataFrame(xs, "x string").repartition(7), "n", "x").collect()
    assert sorted((r.n, r.x) for r in got) == list(enumerate(sorted(x for x, in xs), 1))
    assert number_documents(spark.createDataFrame([], "did string, content string")).count() == 0


def test_constant_length_models(mini):
    """At b = 0 rounding gives every tf back, and BM25 with one length for all is BM1's form."""
    index, queries, _ = mini
    same = reindex.constant_length(index, 400, b=0)
    assert sorted(map(tuple, same.postings.select("termid", "docid", "tf").collect())) == sorted(map(tuple, index.postings.select("termid", "docid", "tf").collect()))
    flat = index.with_(docs=index.docs.withColumn("len", F.lit(float(index.about.avgdl))))
    a = {(r.qid, r.name): r.score for r in rank.score(flat, queries, "bm25").collect()}
    b = {(r.qid, r.name): r.score for r in rank.score(same, queries, "bm25_const").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_priors(spark, mini):
    index, queries, _ = mini
    priors = spark.createDataFrame([("a", 2.0), ("zz", 9.0)], "did string, prior double")
    got = {r.name: r.prior for r in reindex.with_priors(index, priors, default=0.5).docs.collect()}
    assert got == {n: 2.0 if n == "a" else 0.5 for n in "abcdefg"}
    assert {r.score for r in rank.score(reindex.with_priors(index), queries, "lm_prior").collect()} == {None}
    zero = rank.score(reindex.with_priors(index, priors, default=0.0), queries, "lm_prior").where("name <> 'a'").collect()
    assert {r.score for r in zero} == {-math.inf}
    with pytest.raises(ValueError, match="unknown prior"):
        reindex.with_priors(index, init="other")


def test_fitted(spark):
    rng = random.Random(2)
    rows = [(f"d{i:03}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    index = build_index(spark.createDataFrame(rows, "did string, content string")).staged()
    new = reindex.fitted(index, "len")
    lens = sorted((r.len for r in index.docs.collect()), reverse=True)
    points = [(math.log(sum(x >= v for x in lens)), math.log(v)) for v in sorted(set(lens))]
    n = len(points)
    mx, my = sum(x for x, _ in points) / n, sum(y for _, y in points) / n
    slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
    assert abs(new.about.slope - min(slope, 0)) < 1e-9 and abs(new.about.intercept - (my - slope * mx)) < 1e-9 and "len" not in new.docs.columns
    with pytest.raises(ValueError, match="cannot fit"):
        reindex.fitted(index, "name")
    with pytest.raises(ValueError, match="number of bins"):
        reindex.fitted(index, "len", qrels=spark.createDataFrame([], "docno string, rel int"))


def test_grouped_terms_share_ids(spark):
    index = build_index(spark.createDataFrame([("a", "run running runs"), ("b", "running cat"), ("c", "cats")], "did string, content string"))
    got = reindex.grouped(index, "porter")
    by = {r.term: (r.termid, r.df) for r in got.dict.collect()}
    assert len({by[w][0] for w in ("run", "running", "runs")}) == 1 and by["run"][1] == 2 and by["cat"] == by["cats"] and by["cat"][1] == 2
    assert {(r.docid, r.tf) for r in got.postings.where(F.col("termid") == by["run"][0]).collect()} == {(1, 3), (2, 1)}


def test_phrase_index_and_pmi(spark):
    rows = [(f"d{i}", "new york is big, new york is loud" if i % 2 else "york new market") for i in range(20)]
    df = spark.createDataFrame(rows, "did string, content string")
    got = {r.phrase: r for r in phrases.pmi_phrases(df, "content", 10, 0.0).collect()}
    total = sum(len(t.replace(",", " ").split()) for _, t in rows)
    assert abs(got["new york"].pmi - math.log2(20 * total / (30 * 30))) < 1e-9 and got["new york"].df == 10
    index = build_index(df, "phrases", min_freq=5, min_pmi=0.0)
    assert "new york" in {r.term for r in index.dict.collect()} and index.about.tokenizer == "longest"
    limited = build_index(df, "words", limit=3)
    assert limited.dict.count() == 3


def test_evaluation_by_hand(spark):
    run = spark.createDataFrame([("1", "a", 5.0), ("1", "b", 4.0), ("1", "c", 3.0), ("1", "d", 2.0), ("1", "e", 2.0), ("2", "x", 1.0)], "qid string, docno string, score double")
    qrels = spark.createDataFrame([("1", "a", 2), ("1", "b", 0), ("1", "e", 1), ("1", "z", 1), ("1", "c", -1), ("2", "y", 1), ("3", "q", 1)], "qid string, docno string, rel int")
    r = {x.qid: x for x in evaluate.per_query(run, qrels, ndcg=True).collect()}
    # ranks: a b c e d, as ties go to the larger docno; relevant are a, e and the missing z
    assert abs(r["1"].map - (1 + 2 / 4) / 3) < 1e-12 and r["1"].recip_rank == 1 and abs(r["1"].Rprec - 1 / 3) < 1e-12
    assert abs(r["1"].bpref - (1 + 0) / 3) < 1e-12 and abs(r["1"].P_5 - 0.4) < 1e-12
    assert abs(r["1"].ndcg_cut_5 - (2 + 1 / math.log2(5)) / (2 + 1 / math.log2(3) + 1 / 2)) < 1e-12
    assert r["1"].iprec_at_recall_0_60 == 0.5 and r["1"].iprec_at_recall_1_00 == 0 and r["2"].map == 0 and "3" not in r
    m = {x.measure: x.value for x in evaluate.evaluate(run, qrels, complete=True).collect()}
    assert m["num_q"] == 3 and abs(m["map"] - 0.5 / 3) < 1e-12 and m["num_rel"] == 5 and "iprec_at_recall_0.60" in m
    assert abs(m["gm_map"] - math.exp((math.log(0.5) + 2 * math.log(1e-5)) / 3)) < 1e-12


def test_sign_tests_and_parsing(spark, tmp_path):
    for q, (a, b) in enumerate([(0.5, 0.1), (0.4, 0.4), (0.3, 0.2), (0.1, 0.2)], 1):
        d = tmp_path / str(q)
        d.mkdir()
        (d / "eval_phrases_english_-1_4_3.txt").write_text(f"map\tall\t{a}\nAverage cost in postings: {10 * q}\n")
        (d / "eval_phrases_english_-1_1_24.txt").write_text(f"map\tall\t{b}\nnum_q all 1\nnoise\n")
    table = experiments.evaluation_table(experiments.parse_evaluations(readers.read_evaluations(spark, f"file://{tmp_path}")))
    assert table.count() == 8 and {r["average_cost_in_postings"] for r in table.collect()} == {None, 10.0, 20.0, 30.0, 40.0}
    got = {r.min_freq: r for r in experiments.sign_tests(table, "map").collect()}["4"]
    assert (got.n_pairs, got.better, got.worse, got.equal) == (4, 2, 1, 1) and abs(got.p_value - 1.0) < 1e-9


@pytest.mark.parametrize("few", [2048, 0])
def test_containment(spark, monkeypatch, few):
    monkeypatch.setattr(experiments, "FEW_NEEDLES", few)  # 0: texts and needles meet by first letters
    texts = [(1, "alpha beta gamma"), (2, "beta"), (3, None), (4, ""), (5, "xx alpha beta")]
    needles = [("p", "alpha beta"), ("q", "beta"), ("r", ""), ("s", None), ("t", "a"), ("u", "gamma delta")]
    got = {tuple(r) for r in experiments.containments(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(needles, "needle_id string, needle string")).collect()}
    assert got == {(i, n) for i, t in texts for n, x in needles if t and x and x in t}


def test_grid(spark):
    g = experiments.default_grid(spark, [1, 2, 3], [0.0, 24.0])
    assert g.where("mode = 'phrases'").count() == 12 and g.where("mode = 'words'").count() == 2


def test_varints_and_messages():
    for n in (0, 1, 127, 128, 300, 2**31, 2**63 - 1):
        assert ciff.read_varint(ciff.varint(n) + b"x", 0) == (n, len(ciff.varint(n)))
    assert ciff.varint(300) == b"\xac\x02"
    assert ciff.parse_postings(ciff.postings_list("wörd", 2, 5, [(3, 4), (7, 1)])) == ("wörd", 2, 5, [3, 10], [4, 1])
    with pytest.raises(ValueError, match="wire type"):
        list(ciff.fields_of(b"\x0d1234"))


@pytest.mark.parametrize("name", ["x.ciff", "x.ciff.gz"])
def test_interchange_round_trip(spark, mini, tmp_path, name):
    index, queries, _ = mini
    ciff.export_ciff(index, str(tmp_path / name), "mini")
    back = ciff.import_ciff(spark, f"file://{tmp_path}/{name}")
    key = lambda i: sorted(map(tuple, i.postings.join(i.dict, "termid").join(i.docs, "docid").select("term", "df", "name", "tf", "len").collect()))
    assert key(back) == key(index) and back.about.num_docs == 7 and abs(back.about.avgdl - index.about.avgdl) < 1e-12
    a, b = ({(r.qid, r.docno): round(r.score, 9) for r in rank.search(i, queries).collect()} for i in (index, back))
    assert a == b


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "q.tsv").write_text('1\tsay "what\n2\tother .\n')
    assert [tuple(r) for r in readers.read_queries(spark, f"file://{tmp_path}/q.tsv").orderBy("qid").collect()] == [("1", 'say "what'), ("2", "other .")]
    (tmp_path / "bad.tsv").write_text("1\ta\tb\n")
    with pytest.raises(Exception, match="not two parts"):
        readers.read_queries(spark, f"file://{tmp_path}/bad.tsv").collect()
    (tmp_path / "r.txt").write_text("1 0 d1 2\n1  0 d2 0\n")
    assert readers.read_qrels(spark, f"file://{tmp_path}/r.txt").count() == 2 and readers.read_qrels(spark, f"file://{tmp_path}/r.txt", True).count() == 1
    (tmp_path / "p.csv").write_text("did,prior\nd1,0.5\n")
    assert readers.read_priors(spark, f"file://{tmp_path}/p.csv").first().prior == 0.5
    (tmp_path / "n.csv").write_text("1, a b ,3\n2,a b,9\n")
    assert [r.term for r in readers.read_ngrams(spark, f"file://{tmp_path}/n.csv").collect()] == ["a b"]
    q = spark.createDataFrame([("1", "x"), ("2", "y")], "qid string, text string")
    writers.split_queries(q, f"file://{tmp_path}/split")
    assert {p.name for p in (tmp_path / "split").iterdir() if p.is_dir()} == {"qid=1", "qid=2"}
    writers.write_table(q, f"file://{tmp_path}/t", "qid")
    writers.write_settings(spark, {"mode": "words", "limit": -1}, f"file://{tmp_path}/s")
    assert '"limit": -1' in spark.read.text(f"file://{tmp_path}/s").first().value
    df = spark.createDataFrame([(1, "T", None, "x"), (2, None, "B", "y")], "did int, title string, body string, text string")
    assert [r.content for r in readers.corpus_of(df).orderBy("did").collect()] == ["T x", "B y"]


def test_command_line(spark, tmp_path, capsys):
    at = lambda x: f"file://{tmp_path}/{x}"
    run = lambda *a: cli.main(list(a), spark)
    run("index", at("i"), "mini", "--stemmer", "porter")
    with pytest.raises(FileExistsError):
        run("index", at("i"), "mini")
    run("search", at("i"), "mini", "-m", "bm25", "-o", at("run"))
    assert readers.read_run(spark, at("run")).count() > 3
    capsys.readouterr()
    run("search", at("i"), "mini", "-n", "1")
    assert capsys.readouterr().out.startswith("1 Q0 f 0 ")
    run("eval", at("run"), "mini", "-q", "--ndcg", "-c")
    assert "ndcg_cut_5\tall\t" in capsys.readouterr().out
    run("vacuum", at("i"), "--cluster")
    run("index_export", at("i"), str(tmp_path / "x.ciff"), "-d", "mini")
    run("index_import", at("j"), str(tmp_path / "x.ciff"))
    run("reindex_prior", at("j"), at("p"), "--init", "len")
    run("reindex_fitted", at("p"), at("f"), "--column", "prior")
    run("reindex_const", at("j"), at("c"), "--length", "8")
    run("reindex_group", at("j"), at("g"))
    for x, m in (("p", "lm_prior"), ("f", "lm_fitted_prior"), ("c", "lm_const"), ("c", "bm25_const"), ("g", "bm25")):
        run("search", at(x), "mini", "-m", m, "-o", at(f"run-{x}-{m}"))
        assert readers.read_run(spark, at(f"run-{x}-{m}")).count() > 0
    run("report", at("i"))
    assert load_index(spark, at("f")).about.index_type == "fitted"
