"""The registered queries: documents are the collection, benchmark passages the queries.

Indexes are stored once per session and input, as a user would store them, and shared by the queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stemmers, text
from ..index import Index, build_index, document_frequencies, load_index, longest_counts, number_documents, regex_counts, term_positions, top_terms
from ..operators import evaluate, experiments, phrases, rank, reindex
from ..sources import ciff
from ..storage import exists, shared_dir, spread

#: Stop words of the test queries: frequent words of the four languages of the test tables.
STOP = ("a", "and", "das", "de", "der", "die", "el", "en", "in", "la", "le", "les", "of", "the", "to", "und", "y")
VOCABULARY_FREQ = 20
_stored: dict[tuple, str] = {}


def corpus(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("did"), F.col("text").alias("content"))
    return spread(rows)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return number_documents(corpus(spark, d))


def passages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")


def unstopped(spark: SparkSession, d: str) -> DataFrame:
    """The passages without their full stops at the end, which make an empty token that no document has."""
    return passages(spark, d).withColumn("text", F.regexp_replace("text", "[.]+$", ""))


def stored(spark: SparkSession, d: str, name: str, make: Callable[[], Index]) -> Index:
    """The index ``name`` of the tables in ``d``, written once per session."""
    key = (spark.sparkContext.applicationId, d, name)
    path = _stored.get(key)
    if path is None or not exists(spark, path):
        path = shared_dir(spark, f"index-{name}")
        make().save(path)
        _stored[key] = path
    return load_index(spark, path)


def words_index(spark: SparkSession, d: str) -> Index:
    return stored(spark, d, "words", lambda: build_index(corpus(spark, d)))


def stop_index(spark: SparkSession, d: str) -> Index:
    return stored(spark, d, "stop", lambda: build_index(corpus(spark, d), stopwords=STOP))


def file_priors(spark: SparkSession, d: str) -> DataFrame:
    """Priors of some documents: one more than their quality label."""
    return spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").cast("string").alias("did"), (F.col("quality") + 1).cast("double").alias("prior"))


def prior_index(spark: SparkSession, d: str, kind: str) -> Index:
    if kind == "file":
        return stored(spark, d, "prior-file", lambda: reindex.with_priors(words_index(spark, d), file_priors(spark, d), default=0.5))
    return reindex.with_priors(words_index(spark, d), init=kind)


def fitted_index(spark: SparkSession, d: str, column: str) -> Index:
    """Lengths fitted over all their values, priors over twenty bins."""
    if column == "len":
        return stored(spark, d, "fitted-len", lambda: reindex.fitted(words_index(spark, d), "len"))
    return stored(spark, d, "fitted-prior", lambda: reindex.fitted(prior_index(spark, d, "len"), "prior", total=20))


def const_index(spark: SparkSession, d: str, keep_terms: bool = False) -> Index:
    return stored(spark, d, f"const-{keep_terms}", lambda: reindex.constant_length(words_index(spark, d), 400, 0.75, keep_terms, 0.05))


def prefix5(col):
    """A stemmer that SQL has too: the first five letters."""
    return F.substring(col, 1, 5)


def result(run: DataFrame) -> DataFrame:
    return run.withColumn("score", F.round("score", 6))


def searching(index: Callable[[SparkSession, str], Index], model: str, queries=passages, **params):
    return lambda spark, d: result(rank.search(index(spark, d), queries(spark, d), model, 100, **params))


def kept(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from the tables in ``d``, written once per session."""
    key = (spark.sparkContext.applicationId, d, name)
    path = _stored.get(key)
    if path is None or not exists(spark, path):
        path = shared_dir(spark, name)
        make().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(path)


def run_of(spark: SparkSession, d: str, model: str = "lm", index=words_index) -> DataFrame:
    """A run of 100 documents a query, its scores rounded, as it would be written."""
    return kept(spark, d, f"run-{model}-{index.__name__}", lambda: result(rank.search(index(spark, d), passages(spark, d), model, 100)))


def containing(spark: SparkSession, d: str) -> DataFrame:
    """(qid, docno, rel): documents that hold a passage, graded 1 to 3 by their id."""
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text"))
    found = experiments.containments(docs, passages(spark, d).select(F.col("qid").alias("needle_id"), F.col("text").alias("needle")))
    return found.select(F.col("needle_id").alias("qid"), F.col("id").cast("string").alias("docno"), (1 + F.col("id") % 3).cast("int").alias("rel"))


def judgments(spark: SparkSession, d: str) -> DataFrame:
    """The documents holding a passage, and as not relevant the others among the first 20 of the run."""
    good = kept(spark, d, "containing", lambda: containing(spark, d))
    pool = run_of(spark, d).where("rank < 20").select("qid", "docno").join(good, ["qid", "docno"], "left_anti")
    return good.unionByName(pool.withColumn("rel", F.lit(0)))


def measured(spark: SparkSession, d: str, columns: list[str], ndcg: bool = False, complete: bool = False, model: str = "lm") -> DataFrame:
    per = evaluate.per_query(run_of(spark, d, model), judgments(spark, d), complete, ndcg)
    return per.select(F.col("qid").cast("long").alias("qid"), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in columns))


def few_terms(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary for longest matches: the words that occur often enough."""
    found = phrases.token_frequencies(corpus(spark, d), "content")
    return found.where((F.col("freq") >= VOCABULARY_FREQ) & (F.col("token") != "")).select(F.col("token").alias("term"))


def tok_regex_counts(spark, d):
    t = text.regex_tokens(F.col("content"))
    return documents(spark, d).select("docid", "name", F.size(t).cast("long").alias("n_tokens"), F.size(F.filter(t, lambda w: w == "")).cast("long").alias("n_empty"))


def index_dict_limit(spark, d):
    return top_terms(document_frequencies(regex_counts(documents(spark, d))), 500)


def pmi(spark, d):
    return phrases.pmi_phrases(corpus(spark, d), "content", 10, 3.0).withColumn("pmi", F.round("pmi", 6))


def longest_match_query(spark, d):
    folded = passages(spark, d).select("qid", text.folded(F.col("text")).alias("text"))
    found = text.longest_match(folded, "qid", "text", few_terms(spark, d))
    return found.select("qid", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens"))


def longest_match_docs(spark, d):
    return longest_counts(documents(spark, d), few_terms(spark, d))


def phrase_index_report(spark, d):
    return stored(spark, d, "phrases", lambda: build_index(corpus(spark, d), "phrases", min_freq=20, min_pmi=4.0, stopwords=STOP)).report()


def sample(column: str):
    def run(spark, d):
        s = reindex.sample_by_values(words_index(spark, d).docs, column, 10)
        return s.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))

    return run


def renumbered_len(spark, d):
    return stored(spark, d, "renumbered-len", lambda: reindex.renumbered(words_index(spark, d), "len"))


def sample_fixed_points(spark, d):
    s = reindex.sample_by_fixed_points(renumbered_len(spark, d), "len", 0, 20)
    return s.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def sample_fixed_points_qrels(spark, d):
    s = reindex.sample_by_qrels(renumbered_len(spark, d), containing(spark, d), 20)
    return s.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def fit_regression(spark, d):
    s = reindex.sample_by_values(words_index(spark, d).docs, "len", 0)
    return reindex.fit_line(s).select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def ciff_roundtrip(spark, d):
    """Postings of an index that went through an interchange file and back."""
    path = shared_dir(spark, "ciff") + ".ciff.gz"
    ciff.export_ciff(words_index(spark, d), path, "round trip")
    back = ciff.import_ciff(spark, path)
    docs, terms = back.docs.select("docid", "name"), back.dict.select("termid", "term", "df")
    return back.postings.join(terms, "termid").join(docs, "docid").groupBy("term", "df").agg(
        F.count("*").alias("n_docs"), F.sum("tf").alias("cf"), F.min("name").alias("first_name"), F.max("name").alias("last_name")
    )


def sign(value: str, lower_is_better: bool):
    def run(spark, d):
        if value == "map":
            a, b = (measured(spark, d, ["map"], model=m) for m in ("lm", "bm25"))
        else:
            a, b = (run_of(spark, d, index=i).groupBy("qid").agg(F.min("postings_cost").cast("double").alias("cost")) for i in (stop_index, words_index))
        out = experiments.sign_test(a, b, value, lower_is_better)
        return out.withColumn("p_value", F.round("p_value", 6))

    return run


def eval_complete(spark, d):
    """Means over all judged queries of a run that lacks those without a document of all their words."""
    run = result(rank.search(words_index(spark, d), unstopped(spark, d), "lm", 100, conjunctive=True))
    got = evaluate.evaluate(run, judgments(spark, d), complete=True)
    return got.where(F.col("measure").isin("num_q", "num_rel", "num_ret", "num_rel_ret", "map", "recip_rank", "P_10")).select("measure", F.round("value", 6).alias("value"))


def queries_with_2_ngrams(spark, d):
    grams = phrases.ngram_frequencies(corpus(spark, d), "content", 2, 40).where(~F.col("ngram").like(" %") & ~F.col("ngram").like("% ")).select(F.col("ngram").alias("term"))
    return experiments.queries_with_ngrams(passages(spark, d), grams, 2).select("qid", "n_ngrams")


def stem_porter(spark, d):
    return stemmers.stem_terms(words_index(spark, d).dict.select("term"), "term", "porter")


def search_grouped_bm25(spark, d):
    index = stored(spark, d, "grouped-porter", lambda: reindex.grouped(words_index(spark, d), "porter"))
    return result(rank.search(index, passages(spark, d), "bm25", 100))


def search_phrases_lm(spark, d):
    index = stored(spark, d, "phrases", lambda: build_index(corpus(spark, d), "phrases", min_freq=20, min_pmi=4.0, stopwords=STOP))
    return result(rank.search(index, passages(spark, d), "lm", 100))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tok_regex_counts": tok_regex_counts,
    "token_freq": lambda s, d: phrases.token_frequencies(corpus(s, d), "content"),
    "index_docs_len": lambda s, d: words_index(s, d).docs.select("docid", "name", "len"),
    "index_dict_df": lambda s, d: words_index(s, d).dict.select("termid", "term", "df"),
    "index_dict_stopwords": lambda s, d: stop_index(s, d).dict.select("termid", "term", "df"),
    "index_dict_limit": index_dict_limit,
    "index_postings": lambda s, d: words_index(s, d).postings.select("termid", "docid", "fieldid", "tf"),
    "index_stats": lambda s, d: words_index(s, d).stats.select("num_docs", F.round("avgdl", 6).alias("avgdl"), "sumdf", "index_type", "stemmer"),
    "index_report": lambda s, d: words_index(s, d).report().withColumn("avgdl", F.round("avgdl", 6)),
    "terms_positions": lambda s, d: term_positions(documents(s, d), words_index(s, d).dict),
    "ngram_generic_freq": lambda s, d: phrases.ngram_frequencies(corpus(s, d), "content", 3, 5),
    "bigram_freq": lambda s, d: phrases.bigram_frequencies(corpus(s, d), "content", 10),
    "pmi_phrases": pmi,
    "phrase_vocab": lambda s, d: phrases.phrase_vocabulary(corpus(s, d), "content", 10, 5.0, list(STOP)),
    "longest_match_query": longest_match_query,
    "longest_match_docs": longest_match_docs,
    "phrase_index_report": phrase_index_report,
    "query_terms_stats": lambda s, d: rank.query_terms(words_index(s, d), passages(s, d)),
    "search_lm": searching(words_index, "lm"),
    "search_lm_stopwords": searching(stop_index, "lm"),
    "search_lm_fields": searching(words_index, "lm", fields=["content"]),
    "search_lm_conjunctive": searching(words_index, "lm", unstopped, conjunctive=True),
    "search_lm_postings_cost": lambda s, d: rank.postings_cost(words_index(s, d), passages(s, d)),
    "search_bm25": searching(words_index, "bm25"),
    "search_bm25_const": searching(const_index, "bm25_const"),
    "search_lm_const": searching(const_index, "lm_const"),
    "search_lm_prior_len": searching(lambda s, d: prior_index(s, d, "len"), "lm_prior"),
    "search_lm_prior_uniform": searching(lambda s, d: prior_index(s, d, "uniform"), "lm_prior"),
    "search_lm_prior_file": searching(lambda s, d: prior_index(s, d, "file"), "lm_prior"),
    "search_lm_fitted_len": searching(lambda s, d: fitted_index(s, d, "len"), "lm_fitted_len"),
    "search_bm25_fitted": searching(lambda s, d: fitted_index(s, d, "len"), "bm25_fitted"),
    "search_lm_fitted_prior": searching(lambda s, d: fitted_index(s, d, "prior"), "lm_fitted_prior"),
    "search_grouped_bm25": search_grouped_bm25,
    "search_phrases_lm": search_phrases_lm,
    "renumber_by_len": lambda s, d: renumbered_len(s, d).docs.select("docid", "name", "len"),
    "sample_by_values": sample("len"),
    "sample_fixed_points": sample_fixed_points,
    "sample_fixed_points_qrels": sample_fixed_points_qrels,
    "fit_regression": fit_regression,
    "reindex_const_postings": lambda s, d: const_index(s, d).postings.select("termid", "docid", "tf"),
    "reindex_const_keep_terms": lambda s, d: const_index(s, d, True).postings.select("termid", "docid", "tf"),
    "reindex_group_prefix": lambda s, d: reindex.grouped(words_index(s, d), prefix5).dict.select("termid", "term", "df"),
    "stem_porter": stem_porter,
    "ciff_header": lambda s, d: ciff.header(words_index(s, d), "words").withColumn("average_doclength", F.round("average_doclength", 6)),
    "ciff_postings_gaps": lambda s, d: ciff.gaps(words_index(s, d)),
    "ciff_roundtrip": ciff_roundtrip,
    "known_item_qrels": containing,
    "eval_map": lambda s, d: measured(s, d, ["num_rel", "num_ret", "num_rel_ret", "map"]),
    "eval_p_at_k": lambda s, d: measured(s, d, [f"P_{k}" for k in evaluate.P_CUTS]),
    "eval_recip_rank": lambda s, d: measured(s, d, ["recip_rank"]),
    "eval_rprec": lambda s, d: measured(s, d, ["Rprec"]),
    "eval_bpref": lambda s, d: measured(s, d, ["bpref"]),
    "eval_iprec": lambda s, d: measured(s, d, [evaluate.iprec(r) for r in evaluate.RECALLS]),
    "eval_ndcg": lambda s, d: measured(s, d, [f"ndcg_cut_{k}" for k in evaluate.P_CUTS], ndcg=True),
    "eval_complete": eval_complete,
    "eval_cost_avg": lambda s, d: evaluate.cost(run_of(s, d)).withColumn("average_cost", F.round("average_cost", 6)),
    "sign_test_map": sign("map", False),
    "sign_test_cip": sign("cost", True),
    "queries_with_2_ngrams": queries_with_2_ngrams,
    "cluster_terms_layout": lambda s, d: words_index(s, d).clustered().postings.select("termid", "docid", "tf"),
}
