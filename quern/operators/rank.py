"""Ranking: one plan scores a whole set of queries against an index, whatever the model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stemmers, text
from ..functions.text import ln
from ..index import Index
from ..storage import stage

#: Terms of a query set up to this number (some 10 MB) are sent to the postings; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Documents are scored where their postings meet if each task's best ones, queries times limit, are no more than this.
BEST_ROWS = 4_000_000
#: Scores are worked out for so many cells of queries by documents, or query terms met, at a time.
CELLS = 2_000_000
K1, B, LAMBDA = 1.2, 0.75, 0.3


@dataclass(frozen=True)
class Model:
    """``part`` scores a matched term, ``whole`` is added once per document (None: nothing).

    ``repeats``: a term counts as often as the query has it. ``merge``: documents of one name are one result.
    """

    part: Callable[[Index, dict], Column]
    whole: Callable[[Index, dict], Column | None] = lambda index, p: None
    repeats: bool = False
    merge: bool = False


def _fitted(index: Index) -> Column:
    s = index.about
    return F.exp(F.log(F.col("docid")) * F.lit(float(s.slope)) + F.lit(float(s.intercept)))


def _lm(length: Callable[[Index], Column]) -> Callable[[Index, dict], Column]:
    def part(index: Index, p: dict) -> Column:
        weight = F.lit(float(p["lambda_"])) * F.col("tf") * F.lit(float(index.about.sumdf))
        return F.log(1 + weight / (F.lit(1 - float(p["lambda_"])) * F.col("df") * length(index)))

    return part


def _bm25(length: Callable[[Index], Column] | None, shift: int = 1) -> Callable[[Index, dict], Column]:
    def part(index: Index, p: dict) -> Column:
        s, k, b = index.about, float(p["k"]), float(p["b"])
        idf = F.log10((F.lit(float(s.num_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + shift)
        norm = F.lit(1.0) if length is None else F.lit(1 - b) + F.lit(b) * length(index) / F.lit(float(s.avgdl or 1))
        return idf * F.col("tf") * (k + 1) / (F.col("tf") + F.lit(k) * norm)

    return part


def _own(index: Index) -> Column:
    return F.col("len")


def _constant(index: Index) -> Column:
    return F.lit(float(index.about.const_len))


def _slope(index: Index, p: dict) -> Column:
    return F.log(F.col("docid")) * F.lit(float(index.about.slope))


def _kept_prior(index: Index, p: dict) -> Column | None:
    """Of a constant-length index: the prior if documents have one, else the fitted one, else none."""
    if "prior" in index.docs.columns:
        return ln(F.col("prior"))
    return _slope(index, p) if "slope" in index.stats.columns else None


MODELS = {
    "lm": Model(_lm(_own), lambda i, p: ln(F.col("len")), merge=True),
    "bm25": Model(_bm25(_own)),
    "lm_prior": Model(_lm(_own), lambda i, p: ln(F.col("prior"))),
    "lm_const": Model(_lm(_constant), _kept_prior),
    "bm25_const": Model(_bm25(None)),
    "lm_fitted_len": Model(_lm(_fitted), lambda i, p: F.log(_fitted(i))),
    "bm25_fitted": Model(_bm25(_fitted, 0)),
    "lm_fitted_prior": Model(_lm(_own), _slope, repeats=True),
}


def query_tokens(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, term, qtf) of queries(qid, text) under the index's tokenizer and stemmer; empty and unknown tokens stay."""
    s = index.about
    q = queries.select("qid", "text")
    if s.tokenizer == "longest":
        folded = q.select("qid", text.folded(F.col("text")).alias("text"))
        rows = text.longest_match(folded, "qid", "text", index.dict).select("qid", F.explode("tokens").alias("term"))
    else:
        rows = q.select("qid", F.explode(text.regex_tokens(F.col("text"))).alias("term"))
    if s.stemmer != "none":
        stems = stemmers.stem_terms(rows.select("term").distinct(), "term", s.stemmer)
        rows = rows.join(stems, "term").select("qid", F.col("stem").alias("term"))
    return rows.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def query_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, term, qtf, termid, df): the tokens that the dictionary has."""
    return query_tokens(index, queries).join(index.dict, "term").select("qid", "term", "qtf", "termid", "df")


def asked_terms(index: Index, queries: DataFrame) -> DataFrame:
    """``query_terms`` worked out once, and marked for broadcast if they are few: postings stay where they are."""
    terms = stage(query_terms(index, queries), "query-terms")
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def _postings(index: Index, fields: list[str] | None) -> DataFrame:
    if fields is None:
        return index.postings
    return index.postings.join(index.fields.where(F.col("field").isin(*fields)), "fieldid", "left_semi")


def matches(index: Index, terms: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(qid, term, termid, docid, df, qtf, tf): the postings of every asked term, optionally of some fields only."""
    rows = _postings(index, fields).join(terms, "termid")
    if index.has_many_fields:
        rows = rows.groupBy("qid", "term", "termid", "docid").agg(F.max("df").alias("df"), F.max("qtf").alias("qtf"), F.sum("tf").alias("tf"))
    return rows.select("qid", "term", "termid", "docid", "df", "qtf", "tf")


def postings_cost(index: Index, queries: DataFrame, fields: list[str] | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(qid, postings_cost): term-document entries read for each query, a term class read once.

    Entries are counted by term first, so the queries meet one number a term.
    """
    terms = asked_terms(index, queries) if terms is None else terms
    rows = _postings(index, fields).join(terms.select("termid").distinct(), "termid", "left_semi").select("termid", "docid")
    if index.has_many_fields:
        rows = rows.distinct()
    each = rows.groupBy("termid").agg(F.count("*").alias("n"))
    return terms.select("qid", "termid").distinct().join(each, "termid").groupBy("qid").agg(F.sum("n").alias("postings_cost"))


def score(
    index: Index, queries: DataFrame, model: str = "lm", fields: list[str] | None = None, conjunctive: bool = False, k: float = K1, b: float = B, lambda_: float = LAMBDA,
    terms: DataFrame | None = None,
) -> DataFrame:
    """(qid, docid, name, score) of all documents with a matching term; queries without one give no rows.

    ``conjunctive`` keeps documents that have every token of the query, unknown and empty tokens included.
    The join on docid and the sum per query and document share one exchange.
    """
    m, p = MODELS[model], {"k": k, "b": b, "lambda_": lambda_}
    terms = asked_terms(index, queries) if terms is None else terms
    rows = matches(index, terms, fields).join(index.docs, "docid")
    part = m.part(index, p)
    whole = m.whole(index, p)
    rows = rows.withColumn("part", F.col("qtf") * part if m.repeats else part)
    keys = ["qid", "name"] if m.merge else ["qid", "docid", "name"]
    out = rows.withColumn("whole", F.lit(0.0) if whole is None else whole).groupBy(*keys).agg(
        *([F.min("docid").alias("docid")] if m.merge else []),
        (F.sum("part") + F.max("whole")).alias("score"),
        *([F.countDistinct("termid").alias("n_terms")] if conjunctive else []),
    )
    if conjunctive:
        wanted = F.sum("qtf") if m.repeats else F.count("*")
        asked = query_tokens(index, queries).groupBy("qid").agg(wanted.alias("n_asked"))
        out = out.join(asked, "qid").where("n_terms = n_asked")
    return out.select("qid", "docid", "name", "score")


def score_documents(index: Index, pairs: DataFrame, model: str = "lm", **params) -> DataFrame:
    """(qid, name, score) of pairs(qid, text, name): each query against the documents asked for only.

    Postings of other documents leave before they meet a term. A pair without a matching term, or of an unknown document, gives no row.
    """
    asked = pairs.select("qid", "name").distinct()
    docs = index.docs.join(asked.select("name").distinct(), "name", "left_semi")
    few = index.with_(docs=docs, postings=index.postings.join(docs.select("docid"), "docid", "left_semi"))
    scores = score(few, pairs.select("qid", "text").distinct(), model, **params)
    return scores.join(asked, ["qid", "name"], "left_semi").select("qid", "name", "score")


def top_k(scores: DataFrame, k: int = 1000) -> DataFrame:
    """``scores`` with rank 0..k-1 per query by score rounded to 9 digits, then docid. Each task keeps k rows before the exchange."""
    order = W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), F.asc("docid"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("long"))


@dataclass(frozen=True)
class Asked:
    """A query set as arrays. Entry i, of starts[t] to starts[t + 1] for term number t, adds weight[i] times the term's part to query[i].

    ``wanted``: the number of distinct term ids that a document must hold for each query, None for at least one.
    """

    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    queries: int
    wanted: np.ndarray | None


def _asked(terms: pa.Table, repeats: bool, wanted: dict | None) -> tuple[Asked, pa.Table, list]:
    """The arrays of terms(qid, qtf, termid, df), the table (termid, nr, df) of the terms used, and the qids by number."""
    coded = terms.column("qid").combine_chunks().dictionary_encode()
    qids, q = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    termid, df = (terms.column(c).to_numpy() for c in ("termid", "df"))
    ids, first, nr = np.unique(termid, return_index=True, return_inverse=True)
    n = len(qids)
    keys, of = np.unique(nr * n + q, return_inverse=True)
    weight = np.bincount(of, terms.column("qtf").to_numpy().astype(float) if repeats else None, len(keys)).astype(float)
    need = None
    if wanted is not None:  # queries with a token that the dictionary lacks have no result
        need = np.array([wanted[x] for x in qids.to_pylist()], np.int64)
        can = (np.bincount(keys % n, minlength=n) == need)[keys % n]
        keys, weight = keys[can], weight[can]
    asked = Asked(np.searchsorted(keys // n, np.arange(len(ids) + 1)), keys % n, weight, n, need)
    used = np.diff(asked.starts) > 0
    return asked, pa.table({"termid": ids[used], "nr": np.arange(len(ids))[used], "df": df[first][used]}), qids.to_pylist()


class Best:
    """The best ``limit`` rows of each query so far, in the order of ``top_k``: NaN, numbers by their rounded value, null; then docid."""

    def __init__(self, queries: int, limit: int):
        self.limit, self.floor = limit, np.full(queries, -np.inf)
        self.most = max(2 * queries * limit, CELLS)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, score: np.ndarray, null: np.ndarray, kept: np.ndarray, docids: np.ndarray) -> None:
        """Scores of queries by documents, those of them that are null, and those that count."""
        with np.errstate(all="ignore"):
            value = np.copysign(np.floor(np.abs(score) * 1e9 + 0.5) / 1e9, score)
        kind = np.where(null, 2, np.where(np.isnan(value), 0, 1)).astype(np.int8)
        value = np.where(null, -np.inf, np.where(np.isnan(value), np.inf, value))
        q, d = np.nonzero(kept & (value >= self.floor[:, None]))
        self.held.append((q, docids[d], score[q, d], value[q, d], kind[q, d]))
        self.n += len(q)
        if self.n > self.most:
            self.rows()

    def rows(self) -> tuple[np.ndarray, ...]:
        """(query, docid, score, value, kind) of the best."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int8)
        q, docid, score, value, kind = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((docid, -value, kind, q))
        by = q[order]
        place = np.arange(len(by)) - np.searchsorted(by, by)
        last = order[place == self.limit - 1]
        self.floor[q[last]] = value[last]
        order = order[place < self.limit]
        out = (q[order], docid[order], score[order], value[order], kind[order])
        self.held, self.n = [out], len(order)
        return out


def _blocks(met: np.ndarray, queries: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most CELLS cells, and query terms met, or of one document; met[i]: those of the first i."""
    at, step = 0, max(1, CELLS // max(queries, 1))
    while at < len(met) - 1:
        to = max(at + 1, min(at + step, int(np.searchsorted(met, met[at] + CELLS, "right")) - 1, len(met) - 1))
        yield at, to
        at = to


def _best_in(asked: Asked, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(q, docid, score) of a task's best documents, of (docid, whole, hits: [(nr, part)]) a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(asked.queries, limit)
        for batch in batches:
            docids = batch.column("docid").to_numpy()
            wholes = batch.column("whole")
            no_whole, wholes = wholes.is_null().to_numpy(zero_copy_only=False), wholes.fill_null(0.0).to_numpy()
            ends, hits = batch.column("hits").offsets.to_numpy(), batch.column("hits").flatten()
            ends = ends - ends[0]
            nrs, parts = (hits.field(i) for i in range(2))
            no_part = parts.is_null().to_numpy(zero_copy_only=False)
            nrs, parts = nrs.to_numpy(), parts.fill_null(0.0).to_numpy()
            fan = asked.starts[nrs + 1] - asked.starts[nrs]
            met = np.concatenate([[0], np.cumsum(fan)])
            for a, b in _blocks(met[ends], asked.queries):
                i, j, n = ends[a], ends[b], b - a
                f = fan[i:j]
                entry = np.repeat(asked.starts[nrs[i:j]] - (met[i:j] - met[i]), f) + np.arange(met[j] - met[i])
                doc = np.repeat(np.repeat(np.arange(n), np.diff(ends[a : b + 1])), f)
                cell, size = asked.query[entry] * n + doc, asked.queries * n
                shape = (asked.queries, n)
                score = np.bincount(cell, np.repeat(parts[i:j], f) * asked.weight[entry], size).reshape(shape) + wholes[a:b]
                held = np.bincount(cell, minlength=size).reshape(shape)
                null = np.broadcast_to(no_whole[a:b], shape)
                if no_part[i:j].any():  # a sum leaves nulls out, and is null of nothing else
                    null = null | (held == np.bincount(cell, np.repeat(no_part[i:j], f).astype(float), size).reshape(shape))
                best.add(score, null, held > 0 if asked.wanted is None else held == asked.wanted[:, None], docids[a:b])
        q, docid, score, _, kind = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(docid, pa.int64()), pa.array(score, pa.float64(), mask=kind == 2)], names=["q", "docid", "score"])

    return run


def best_documents(
    index: Index, queries: DataFrame, terms: DataFrame, model: str, limit: int, fields: list[str] | None = None, conjunctive: bool = False,
    k: float = K1, b: float = B, lambda_: float = LAMBDA,
) -> DataFrame:
    """(qid, docid, name, score, rank): ``top_k`` of ``score``.

    A query set of few terms is sent to the postings. Those that it asks for, each once however many queries ask for it, meet by
    document; a task scores its documents for all queries and hands on the best ones only. Larger sets, and documents that
    share a name under a model that merges them, take the general way.
    """
    m, p = MODELS[model], {"k": k, "b": b, "lambda_": lambda_}
    spark = index.docs.sparkSession
    n_terms = terms.count()
    n_queries = terms.select("qid").distinct().count() if 0 < n_terms <= BROADCAST_TERMS else 0
    if not n_queries or n_queries * limit > BEST_ROWS or (m.merge and not index.has_own_names):
        return top_k(score(index, queries, model, fields, conjunctive, k, b, lambda_, terms), limit)
    wanted = None
    if conjunctive:
        each = query_tokens(index, queries).groupBy("qid").agg((F.sum("qtf") if m.repeats else F.count("*")).alias("n"))
        wanted = {r.qid: r.n for r in each.collect()}
    asked, used, qids = _asked(terms.where("qid IS NOT NULL").select("qid", "qtf", "termid", "df").toArrow(), m.repeats, wanted)
    rows = _postings(index, fields).join(F.broadcast(spark.createDataFrame(used)), "termid").select("docid", "nr", "df", "tf")
    if index.has_many_fields:
        rows = rows.repartition("docid").groupBy("docid", "nr", "df").agg(F.sum("tf").alias("tf"))
    rows = rows.join(index.docs.drop("name"), "docid")
    whole = m.whole(index, p)
    rows = rows.select("docid", (F.lit(0.0) if whole is None else whole).cast("double").alias("whole"), "nr", m.part(index, p).cast("double").alias("part"))
    by_doc = rows.groupBy("docid").agg(F.max("whole").alias("whole"), F.collect_list(F.struct("nr", "part")).alias("hits"))
    best = by_doc.mapInArrow(_best_in(asked, limit), "q int, docid long, score double")
    named = spark.createDataFrame(list(enumerate(qids)), T.StructType([T.StructField("q", T.IntegerType()), T.StructField("qid", terms.schema["qid"].dataType)]))
    best = top_k(best.join(F.broadcast(named), "q").drop("q"), limit)
    return best.join(index.docs.select("docid", "name"), "docid").select("qid", "docid", "name", "score", "rank")


def search(index: Index, queries: DataFrame, model: str = "lm", limit: int = 1000, fields: list[str] | None = None, first: int | None = None, last: int | None = None, **params) -> DataFrame:
    """(qid, docno, rank, score, postings_cost): the ``limit`` best documents of each query, qid from ``first`` to ``last``."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    for bound, keep in ((first, lambda q: q >= first), (last, lambda q: q <= last)):
        if bound is not None:
            queries = queries.where(keep(F.col("qid").cast("long")))
    terms = asked_terms(index, queries)
    best = best_documents(index, queries, terms, model, limit, fields, **params)
    cost = postings_cost(index, queries, fields, terms)
    return best.join(cost, "qid").select("qid", F.col("name").alias("docno"), "rank", "score", "postings_cost")
