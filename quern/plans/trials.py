"""More registered queries: files written and read back, the command line, fields, and experiments in batches."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..index import build_fielded_index, build_index, compact, load_index
from ..operators import evaluate, experiments, phrases, rank, reindex
from ..sources import ciff, readers, writers
from ..storage import shared_dir
from . import catalogue, sql
from .catalogue import STOP, const_index, containing, corpus, judgments, passages, prior_index, result, run_of, stop_index, stored, words_index
from .sql import AP, BASE, COUNTS, JUDGED, PARTS, RUN, SEARCH, TOKENS, bm25, chain, lm, other_run, ranks, zero


# files: what is written is what is read back
def queries_file(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "queries")
    writers.write_queries(passages(spark, d), path)
    return readers.read_queries(spark, path)


def qrels_file(spark, d):
    path = shared_dir(spark, "qrels")
    writers.write_qrels(containing(spark, d), path)
    return readers.read_qrels(spark, path, judged_only=True)


def priors_file(spark, d):
    path = shared_dir(spark, "priors")
    writers.write_table(catalogue.file_priors(spark, d), path)
    return readers.read_priors(spark, path)


def run_file(spark, d):
    path = shared_dir(spark, "run")
    writers.write_run(run_of(spark, d), path)
    return readers.read_run(spark, path)


def ngrams_file(spark, d):
    path = shared_dir(spark, "ngrams")
    found = phrases.ngram_frequencies(corpus(spark, d), "content", 2, 40)
    found.select(F.lit("1").alias("id"), "ngram", "freq").write.csv(path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_ngrams(spark, path)


def corpus_file(spark, d):
    """Conversations as JSON, their role as the title."""
    path = shared_dir(spark, "corpus")
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("title"), "text").write.json(path)
    return readers.read_corpus(spark, path, "json", "id")


def split_file(spark, d):
    path = shared_dir(spark, "split")
    writers.split_queries(passages(spark, d), path)
    return spark.read.schema("value string, qid long").text(path).select("qid", F.col("value").alias("text"))


def sample_file(spark, d):
    path = shared_dir(spark, "sample")
    writers.write_sample(reindex.sample_by_values(words_index(spark, d).docs, "len", 10), path)
    return spark.read.csv(path, sep="\t", schema="x double, y double").select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def table_file(spark, d):
    path = shared_dir(spark, "table")
    writers.write_table(spark.read.parquet(f"{d}/labels.parquet"), path, "doc_id")
    return spark.read.csv(path, header=True, schema="doc_id long, quality int, toxic int")  # columns are written by name


def settings_file(spark, d):
    path = shared_dir(spark, "settings")
    writers.write_settings(spark, {"mode": "phrases", "limit": -1, "min_pmi": 4.0}, path)
    return spark.read.schema("mode string, limit int, min_pmi double").json(path)


def mini_collection(spark, d):
    return readers.collection(spark, "mini")[0]


def command_line(spark, d):
    """Index, search and stored run of the command line."""
    at = shared_dir(spark, "command")
    writers.write_queries(passages(spark, d), f"{at}/queries")
    cli.main(["index", f"{at}/index", f"{d}/documents.parquet", "--id", "doc_id"], spark)
    cli.main(["search", f"{at}/index", f"{at}/queries", "-m", "lm", "-n", "100", "-o", f"{at}/run"], spark)
    return readers.read_run(spark, f"{at}/run").withColumn("score", F.round("score", 6))


def compacted(spark, d):
    path = shared_dir(spark, "compacted")
    words_index(spark, d).save(path)
    return compact(spark, path).postings.select("termid", "docid", "tf")


# indexes
def words_mode(spark, d):
    return stored(spark, d, "words-mode", lambda: build_index(corpus(spark, d), "words", stopwords=STOP)).stats.select(
        "num_docs", F.round("avgdl", 6).alias("avgdl"), "sumdf", "index_type", "tokenizer"
    )


def limited(spark, d):
    """The vocabulary cut to 300 terms, texts matched again, terms that no text has left dropped."""
    return stored(spark, d, "limited", lambda: build_index(corpus(spark, d), "words", limit=300)).dict.select("term", "df")


def fielded_index(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("did"), F.col("source").alias("title"), F.col("text").alias("body"))
    return stored(spark, d, "fielded", lambda: build_fielded_index(rows, ("title", "body")))


def fielded(fields: list[str] | None):
    return lambda spark, d: result(rank.search(fielded_index(spark, d), passages(spark, d), "lm", 100, fields=fields))


def const_prior(spark, d):
    """Constant length under a prior: the prior goes before a fitted slope."""
    index = stored(spark, d, "const-prior", lambda: reindex.constant_length(prior_index(spark, d, "file"), 400, 0.75, maxp=0.05))
    return result(rank.search(index, passages(spark, d), "lm_const", 100))


def grouped_prefix(spark, d):
    """Terms grouped by a stemmer that SQL has too."""
    index = stored(spark, d, "grouped-prefix", lambda: reindex.grouped(words_index(spark, d), catalogue.prefix5))
    return result(rank.search(index, passages(spark, d), "bm25", 100))


def one_document(spark, d):
    """The language model's score of the documents that hold a passage."""
    pairs = containing(spark, d).join(passages(spark, d), "qid").select("qid", "text", F.col("docno").alias("name"))
    return result(rank.score_documents(words_index(spark, d), pairs))


def longest_tokens(spark, d):
    """Query tokens of an imported index under the longest-match tokenizer."""
    path = shared_dir(spark, "ciff") + ".ciff"
    ciff.export_ciff(words_index(spark, d), path, "tokens")
    return rank.query_tokens(ciff.import_ciff(spark, path, "longest"), passages(spark, d))


# experiments
def batch_map(spark, d):
    """Two indexes under two models, evaluated at once."""
    indexes = {"words": words_index(spark, d), "stop": stop_index(spark, d)}
    runs = result(experiments.batch_search(indexes, {"passages": passages(spark, d)}, ("lm", "bm25"), 100))
    per = experiments.batch_evaluate(runs, judgments(spark, d))
    return per.select("config", F.col("qid").cast("long").alias("qid"), F.round("map", 6).alias("map"))


def evaluation_lines(spark, d) -> DataFrame:
    """lines(query, config, value) of two runs by query; the names stand for parameters."""
    out = None
    for model, config in (("lm", "eval_words_none_-1_1_24"), ("bm25", "eval_words_none_-1_4_3")):
        per = catalogue.measured(spark, d, ["map"], model=model)
        cost = run_of(spark, d, model).groupBy("qid").agg(F.min("postings_cost").alias("cost"))
        rows = per.select("qid", F.concat_ws("\t", F.lit("map"), F.lit("all"), F.col("map").cast("string")).alias("value"))
        rows = rows.unionByName(cost.select("qid", F.concat(F.lit("Average cost in postings: "), F.col("cost").cast("double").cast("string")).alias("value")))
        rows = rows.select(F.col("qid").cast("string").alias("query"), F.lit(config).alias("config"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def parsed(spark, d) -> DataFrame:
    path = shared_dir(spark, "evaluations")
    writers.write_evaluations(evaluation_lines(spark, d), path)
    return experiments.evaluation_table(experiments.parse_evaluations(readers.read_evaluations(spark, path)))


def evaluations_table(spark, d):
    return parsed(spark, d).select("query", "mode", "stopwords", "min_freq", "min_pmi", "map", "average_cost_in_postings")


def sign_grid(spark, d):
    return experiments.sign_tests(parsed(spark, d), "map").withColumn("p_value", F.round("p_value", 6))


SHOWN = ("num_q", "num_rel", "num_ret", "num_rel_ret", "map", "gm_map")


def evaluation_rows(spark, d):
    """Rows of each query and of all, as the command line prints them."""
    got = evaluate.evaluate(run_of(spark, d), judgments(spark, d), query_eval=True)
    return got.where(F.col("measure").isin(*SHOWN)).select("qid", "measure", F.round("value", 6).alias("value"))


def end_to_end(spark, d):
    """Index, search and evaluation in one call, all of it stored."""
    at = shared_dir(spark, "experiment")
    got = experiments.run_experiment(corpus(spark, d), passages(spark, d), judgments(spark, d), at, model="lm", limit=100)
    return got.where(F.col("measure").isin(*SHOWN)).select("measure", F.round("value", 6).alias("value"))


def parameter_grid(spark, d):
    return experiments.default_grid(spark, [1, 2, 4, 8], [0.0, 24.0])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "file_queries": queries_file,
    "file_qrels": qrels_file,
    "file_priors": priors_file,
    "file_run": run_file,
    "file_ngrams": ngrams_file,
    "file_corpus": corpus_file,
    "file_split_queries": split_file,
    "file_sample": sample_file,
    "file_table": table_file,
    "file_settings": settings_file,
    "mini_collection": mini_collection,
    "command_line": command_line,
    "index_compacted": compacted,
    "index_words_mode": words_mode,
    "index_limited": limited,
    "search_field_body": fielded(["body"]),
    "search_both_fields": fielded(None),
    "search_const_prior": const_prior,
    "search_grouped_prefix": grouped_prefix,
    "score_documents": one_document,
    "longest_query_tokens": longest_tokens,
    "batch_map": batch_map,
    "evaluations_table": evaluations_table,
    "sign_tests_grid": sign_grid,
    "eval_rows": evaluation_rows,
    "experiment_end_to_end": end_to_end,
    "parameter_grid": parameter_grid,
}


def suffixed(steps: dict[str, str], suffix: str) -> dict[str, str]:
    """The steps under other names, and what they read from each other too."""
    names = re.compile(r"\b(" + "|".join(steps) + r")\b(?!\()")
    return {n + suffix: names.sub(lambda m: m[1] + suffix, s) for n, s in steps.items()}


INDEX = ("pc", "dict", "post", "docs", "stats", "qd", "m", "cost")
STOP_SEARCH = suffixed({n: sql.NOSTOP.get(n, PARTS[n]) for n in INDEX} | lm() | other_run(bm25(), "b"), "_s")
FOUR = lm() | other_run(bm25(), "b") | STOP_SEARCH | JUDGED | ranks("run") | ranks("run_b") | ranks("run_s") | ranks("run_b_s")
EACH = f"SELECT '{{0}}' AS config, qid, {zero(AP, 'map')} FROM e{{1}} GROUP BY qid"
BATCH = " UNION ALL ".join(EACH.format(c, r) for c, r in (("words/passages/lm", "run"), ("words/passages/bm25", "run_b"), ("stop/passages/lm", "run_s"), ("stop/passages/bm25", "run_b_s")))

TABLE = " UNION ALL ".join(
    f"SELECT CAST(e.qid AS VARCHAR) AS query, 'words' AS mode, 'none' AS stopwords, '{f}' AS min_freq, '{p}' AS min_pmi, any_value(e.map) AS map, CAST(any_value(c.postings_cost) AS DOUBLE) AS average_cost_in_postings "
    f"FROM (SELECT qid, postings_cost FROM {r} GROUP BY ALL) c LEFT JOIN (SELECT qid, {zero(AP, 'map')} FROM e{r} GROUP BY qid) e ON e.qid = c.qid GROUP BY e.qid"
    for f, p, r in (("1", "24", "run"), ("4", "3", "run_b"))
)
GRID_SIGN = sql.SIGN.replace("SELECT n_pairs", "SELECT mode, stopwords, min_freq, min_pmi, n_pairs", 1)
GRID_COUNTS = COUNTS.format("x > y", "x < y").replace("SELECT count(*) AS n_pairs", "SELECT mode, stopwords, min_freq, min_pmi, count(*) AS n_pairs", 1) + " GROUP BY ALL"
ROWS = {
    "per": f"SELECT qid, CAST(any_value(num_rel) AS DOUBLE) AS num_rel, CAST(count(*) AS DOUBLE) AS num_ret, CAST(sum(hit) AS DOUBLE) AS num_rel_ret, coalesce({AP} / greatest(max(num_rel), 1), 0) AS map FROM erun GROUP BY qid",
    "total": "SELECT 'all' AS qid, CAST(count(*) AS DOUBLE) AS num_q, sum(num_rel) AS num_rel, sum(num_ret) AS num_ret, sum(num_rel_ret) AS num_rel_ret, avg(map) AS map, exp(avg(ln(greatest(map, 0.00001::DOUBLE)))) AS gm_map FROM per",
    "all_rows": "SELECT qid, measure, round(value, 6) AS value FROM (UNPIVOT total ON num_q, num_rel, num_ret, num_rel_ret, map, gm_map INTO NAME measure VALUE value)",
    "own_rows": "SELECT CAST(qid AS VARCHAR) AS qid, measure, round(value, 6) AS value FROM (UNPIVOT per ON num_rel, num_ret, num_rel_ret, map INTO NAME measure VALUE value)",
}
EVALUATED = lm() | JUDGED | ranks("run") | ROWS
CONST_PRIOR = {"pd": "SELECT docid, name, len, coalesce(quality + 1, 0.5::DOUBLE) AS prior FROM docs LEFT JOIN labels ON name = CAST(doc_id AS VARCHAR)"} | lm("400.0::DOUBLE", "ln(prior)", docs="pd")
# postings of two fields; a document's length and a term's df count both
TWO = {
    "d": "SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS docid, CAST(doc_id AS VARCHAR) AS name, coalesce(source, '') AS title, coalesce(text, '') AS body FROM documents",
    "tok": " UNION ALL ".join(f"SELECT docid, '{f}' AS field, unnest({sql.WORDS.format(f)}) AS token FROM d" for f in ("title", "body")),
    "fc": "SELECT docid, field, token AS term, count(*) AS tf FROM tok WHERE token <> '' GROUP BY ALL",
    "pc": "SELECT docid, term, sum(tf) AS tf FROM fc GROUP BY ALL",
    "dict": PARTS["dict"],
    "post": "SELECT termid, docid, sum(tf) AS tf FROM fc JOIN dict USING (term) WHERE {} GROUP BY ALL",
} | {n: PARTS[n] for n in ("docs", "stats", "q", "qt", "qd", "m", "cost")}


def two_fields(which: str) -> str:
    return chain(RUN, **(TWO | {"post": TWO["post"].format(which)}), **lm())


# terms of one prefix share id, df and postings; a query reads each class once; sumdf stays
GROUPED = {
    "dict0": PARTS["dict"],
    "dict": "SELECT dense_rank() OVER (ORDER BY s) AS termid, term, df FROM (SELECT term, left(term, 5) AS s FROM dict0) JOIN (SELECT left(term, 5) AS s, count(DISTINCT docid) AS df FROM pc GROUP BY 1) USING (s)",
    "post": "SELECT termid, docid, sum(tf) AS tf FROM pc JOIN dict USING (term) GROUP BY ALL",
    "docs": PARTS["docs"],
    "stats": PARTS["stats"].replace("FROM dict)", "FROM dict0)"),
} | {n: PARTS[n] for n in ("q", "qt", "qd", "m")}
GROUPED["cost"] = "SELECT qid, count(*) AS postings_cost FROM (SELECT DISTINCT qid, termid, docid FROM m) GROUP BY qid"
GRAMS = f"SELECT trim(w1 || ' ' || w2) AS term FROM ({sql.PAIRS.replace('>= 10', '>= 40')})"
SQL = {
    "file_queries": "SELECT CAST(item_id AS VARCHAR) AS qid, regexp_replace(text, '[\\t\\n\\r]+', ' ', 'g') AS text FROM benchmark",
    "file_qrels": chain("SELECT CAST(qid AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS docno, rel FROM rel WHERE rel <> 0", "rel"),
    "file_priors": "SELECT CAST(doc_id AS VARCHAR) AS did, CAST(quality + 1 AS DOUBLE) AS prior FROM labels",
    "file_run": chain("SELECT CAST(qid AS VARCHAR) AS qid, docno, rank, score, 'lm' AS tag, postings_cost FROM run", *SEARCH, **lm()),
    "file_ngrams": chain("SELECT DISTINCT term FROM g WHERE term <> ''", *TOKENS, g=GRAMS),
    "file_corpus": "SELECT concat_ws('-', conv_id, turn) AS did, concat_ws(' ', role, text) AS content FROM conversations",
    "file_split_queries": "SELECT item_id AS qid, regexp_replace(text, '[\\t\\n\\r]+', ' ', 'g') AS text FROM benchmark",
    "file_sample": sql.SQL["sample_by_values"],
    "file_table": "SELECT doc_id, CAST(quality AS INTEGER) AS quality, CAST(toxic AS INTEGER) AS toxic FROM labels",
    "file_settings": "SELECT 'phrases' AS mode, -1 AS limit, 4.0::DOUBLE AS min_pmi",
    "mini_collection": "SELECT * FROM (VALUES ('a', 'Café culture: coffee, coffee and more COFFEE.'), ('b', 'High-speed rail links the north and the south.'), "
    "('c', 'Rail freight is slow; high freight rates are not.'), ('d', 'The naïve reader''s résumé'), ('e', ''), ('f', 'coffee trade by rail in 1905'), ('g', 'South coast weather: wind, wind, rain')) t(did, content)",
    "command_line": chain("SELECT CAST(qid AS VARCHAR) AS qid, docno, rank, score, 'lm' AS tag, postings_cost FROM run", *SEARCH, **lm()),
    "index_compacted": sql.SQL["cluster_terms_layout"],
    "index_words_mode": chain("SELECT num_docs, round(avgdl, 6) AS avgdl, sumdf, 'words' AS index_type, 'longest' AS tokenizer FROM stats", *BASE, **sql.NOSTOP),
    "index_limited": chain(
        "SELECT term, count(*) AS df FROM matched GROUP BY term", *TOKENS, "pc", "dict",
        v="SELECT term FROM (SELECT term, row_number() OVER (ORDER BY df DESC, term) AS r FROM dict) WHERE r <= 300", matched=sql.MATCHED,
    ),
    "search_field_body": two_fields("field = 'body'"),
    "search_both_fields": two_fields("true"),
    "search_const_prior": sql.with_const(CONST_PRIOR),
    "search_grouped_prefix": chain(RUN, *TOKENS, "pc", **GROUPED, **bm25()),
    "score_documents": chain("SELECT sc.qid, name, round(score, 6) AS score FROM sc JOIN rel ON rel.qid = sc.qid AND name = CAST(doc_id AS VARCHAR)", *SEARCH, "rel", **lm()),
    "longest_query_tokens": chain("SELECT qid, term, qtf FROM qt", *TOKENS, "pc", "dict", "q", qt=sql.LONGEST_QUERY),
    "batch_map": chain(BATCH, *SEARCH, "rel", **FOUR),
    "evaluations_table": chain(TABLE, *SEARCH, "rel", **sql.two_runs()),
    "sign_tests_grid": chain(
        GRID_SIGN, *SEARCH, "rel", **sql.two_runs(), tab=TABLE,
        p="SELECT mode, stopwords, min_freq, min_pmi, a.map AS x, b.map AS y FROM tab a JOIN (SELECT query, map FROM tab WHERE min_freq = '1') b USING (query) WHERE a.map IS NOT NULL AND b.map IS NOT NULL",
        s=GRID_COUNTS, t=sql.TAIL,
    ),
    "eval_rows": chain("FROM all_rows UNION ALL FROM own_rows", *SEARCH, "rel", **EVALUATED),
    "experiment_end_to_end": chain("SELECT measure, value FROM all_rows", *SEARCH, "rel", **EVALUATED),
    "parameter_grid": "SELECT s.stopwords, m.mode, CAST(-1 AS BIGINT) AS limit, CAST(f.min_freq AS BIGINT) AS min_freq, p.min_pmi FROM (VALUES ('english'), ('none')) s(stopwords), "
    "(VALUES ('words'), ('phrases')) m(mode), (VALUES (1), (2), (4), (8)) f(min_freq), (VALUES (0.0::DOUBLE), (24.0::DOUBLE)) p(min_pmi) WHERE m.mode = 'phrases' OR (f.min_freq = 1 AND p.min_pmi = 0)",
}
