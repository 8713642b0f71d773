"""A text index as a handful of immutable tables, and its construction from documents."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import stemmers, text
from .functions.stopwords import stop_words
from .operators.phrases import phrase_vocabulary, without_words
from .storage import exists, number_rows, remove, replace_text, shared_dir, stage

TABLES = ("docs", "dict", "postings", "fields", "stopwords", "stats")
CURRENT = "CURRENT"
#: A vocabulary of up to so many terms (some 10 MB) is sent to the counts; a larger one is joined by a shuffle.
SENT_TERMS = 200_000


@dataclass(frozen=True)
class Index:
    """docs(docid, name, len [, prior]), dict(termid, term, df), postings(termid, docid, fieldid, tf),
    fields(fieldid, field), stopwords(sw) and the one-row stats(num_docs, avgdl, sumdf, index_type, stemmer,
    tokenizer [, const_len] [, slope, intercept]). Postings hold a row per term, document and field.
    """

    docs: DataFrame
    dict: DataFrame
    postings: DataFrame
    fields: DataFrame
    stopwords: DataFrame
    stats: DataFrame

    @cached_property
    def about(self) -> Row:
        """The row of stats."""
        return self.stats.first()

    @cached_property
    def has_many_fields(self) -> bool:
        return self.fields.limit(2).count() > 1

    @cached_property
    def has_own_names(self) -> bool:
        """Whether no two documents share a name."""
        return self.docs.groupBy("name").count().where("count > 1").isEmpty()

    def with_(self, **tables: DataFrame) -> Index:
        return replace(self, **tables)

    def terms(self) -> DataFrame:
        """One row per occurrence: docid, fieldid, termid."""
        return self.postings.select("docid", "fieldid", "termid", F.explode(F.sequence(F.lit(1), F.col("tf"))).alias("n")).drop("n")

    def clustered(self) -> Index:
        """Postings by ranges of term and document, dictionary by term, documents by id: a query's terms then
        touch few row groups, as Parquet's bounds exclude the rest."""
        return self.with_(
            postings=self.postings.repartitionByRange("termid", "docid").sortWithinPartitions("termid", "docid"),
            dict=self.dict.repartitionByRange("term").sortWithinPartitions("term"),
            docs=self.docs.repartitionByRange("docid").sortWithinPartitions("docid"),
        )

    def save(self, path: str, overwrite: bool = False) -> Index:
        """Writes all tables below ``path`` and returns the index that reads them. An existing index stays unless ``overwrite``.

        Tables lie in a folder of their own for each version; the file CURRENT, replaced by one rename, names the one
        that counts, so a crash leaves the old index whole. Old versions are removed after that.
        """
        spark, path = self.docs.sparkSession, path.rstrip("/")
        old = current_version(spark, path)
        if exists(spark, path) and not overwrite:
            raise FileExistsError(path)
        version = f"v-{uuid.uuid4().hex}"
        for t in TABLES:
            getattr(self, t).write.parquet(f"{path}/{version}/{t}")
        replace_text(spark, f"{path}/{CURRENT}", version)
        if old:
            remove(spark, f"{path}/{old}")
        return load_index(spark, path)

    def staged(self, name: str = "index") -> Index:
        return self.save(shared_dir(self.docs.sparkSession, name))

    def report(self) -> DataFrame:
        """One row: dictionary size, occurrences, phrases, avgdl and sumdf."""
        d = self.dict.agg(F.count("*").alias("dict_terms"), F.count_if(F.col("term").contains(" ")).alias("ngrams"))
        p = self.postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("term_rows"))
        return d.join(p).join(self.stats.select("num_docs", "avgdl", "sumdf"))


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that counts; None without a stored index."""
    at = f"{path.rstrip('/')}/{CURRENT}"
    return spark.read.text(at).first()[0] if exists(spark, at) else None


def load_index(spark: SparkSession, path: str) -> Index:
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no index in {path}")
    return Index(**{t: spark.read.parquet(f"{path.rstrip('/')}/{version}/{t}") for t in TABLES})


def compact(spark: SparkSession, path: str, cluster: bool = True) -> Index:
    """Rewrites a stored index in place, clustered on demand: small files go, the old tables are replaced at once."""
    kept = load_index(spark, path)
    return (kept.clustered() if cluster else kept).save(path, overwrite=True)


def number_documents(corpus: DataFrame) -> DataFrame:
    """(docid, name, content): corpus(did, content) numbered from 1 in the order of did; null names go, null content is empty."""
    return number_rows(named_texts(corpus, "content"), "docid", "name")


def named_texts(corpus: DataFrame, *fields: str) -> DataFrame:
    """(name, fields) of corpus(did, fields): null names go, null texts are empty."""
    rows = corpus.select(F.col("did").cast("string").alias("name"), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields))
    return rows.where("name IS NOT NULL")


def numbered_counts(corpus: DataFrame, *fields: str) -> DataFrame:
    """(docid, name, and for each field the counts of its words, [(term, tf)]): the text moves once and is not staged."""

    def count(rows: DataFrame) -> DataFrame:
        for f in fields:
            rows = text.word_counts(rows, words_of(F.col(f)), f)
        return rows

    return number_rows(named_texts(corpus, *fields), "docid", "name", then=count)


def regex_counts(docs: DataFrame, stopwords: list[str] | None = None, stemmer: str = "none") -> DataFrame:
    """(docid, term, tf) of the non-empty words that are not stop words, stemmed."""
    rows = text.word_counts(docs.select("docid", "content"), words_of(F.col("content"))).select("docid", "terms")
    counts = listed_counts(rows, stopwords)
    return counts if stemmer == "none" else stemmed_counts(counts, stemmer)


def words_of(content: Column) -> Column:
    return F.filter(text.regex_tokens(content), lambda w: w != "")


def listed_counts(lists: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """(docid, term, tf) of lists(docid, terms) without the stop words."""
    return without_words(lists.select("docid", F.inline("terms")), stopwords, "term")


def stemmed_counts(counts: DataFrame, stemmer: str) -> DataFrame:
    stems = stemmers.stem_terms(counts.select("term").distinct(), "term", stemmer)
    return counts.join(stems, "term").groupBy("docid", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def term_positions(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(docid, pos, termid): every non-empty word of the regex tokenizer with its place among them, from 1; no window."""
    words = F.filter(text.regex_tokens(F.col("content")), lambda w: w != "")
    rows = docs.select("docid", F.posexplode(words).alias("at", "term"))
    return rows.join(vocabulary.select("termid", "term"), "term").select("docid", (F.col("at") + 1).cast("long").alias("pos"), "termid")


def longest_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(docid, term, tf) of the greedy longest matches of ``vocabulary(term)`` in the cleaned texts."""
    cleaned = docs.select("docid", text.clean(F.col("content")).alias("content"))
    found = text.longest_match(cleaned, "docid", "content", vocabulary)
    return text.word_counts(found.select("docid", "tokens"), F.col("tokens")).select("docid", F.inline("terms"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def top_terms(frequencies: DataFrame, most: int) -> DataFrame:
    """The ``most`` terms of largest df, ties by term, with their rank as termid."""
    best = frequencies.orderBy(F.desc("df"), "term").limit(most)
    return number_rows(best, "termid", F.desc("df"), F.asc("term")).select("termid", "term", "df")


def assemble(
    docs: DataFrame, counts: DataFrame, vocabulary: DataFrame, stopwords: list[str], index_type: str, stemmer: str, tokenizer: str, fields: tuple[str, ...] = ("content",)
) -> Index:
    """The index of ``counts(docid, term, tf [, fieldid])`` over ``vocabulary(termid, term, df)``, which has every term counted.

    Only the postings meet the vocabulary, once and without a sort; lengths come from the counts.
    """
    spark = docs.sparkSession
    field = F.col("fieldid") if "fieldid" in counts.columns else F.lit(0).cast("long").alias("fieldid")
    ids = vocabulary.select("termid", "term")
    ids = F.broadcast(ids) if ids.count() <= SENT_TERMS else ids.hint("shuffle_hash")
    postings = counts.join(ids, "term").select("termid", "docid", field, "tf")
    lengths = counts.groupBy("docid").agg(F.sum("tf").alias("len"))
    docs = docs.select("docid", "name").join(lengths, "docid", "left").withColumn("len", F.coalesce("len", F.lit(0)))
    sizes = docs.agg(F.count("*").alias("num_docs"), F.avg("len").alias("avgdl"))
    stats = sizes.join(vocabulary.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("sumdf"))).withColumns(
        {"index_type": F.lit(index_type), "stemmer": F.lit(stemmer), "tokenizer": F.lit(tokenizer)}
    )
    named = spark.createDataFrame(list(enumerate(fields)), "fieldid long, field string")
    stop = spark.createDataFrame([(w,) for w in stopwords], "sw string")
    return Index(docs, vocabulary.select("termid", "term", "df"), postings, named, stop, stats)


def build_index(
    corpus: DataFrame, mode: str = "standard", stemmer: str = "none", stopwords="none", limit: int = -1, min_freq: int = 10, min_pmi: float = 5.0
) -> Index:
    """Index of corpus(did, content).

    ``standard``: words of the regex tokenizer, stop words dropped, stemmed. ``words``: the same without stemming
    documents; with ``limit`` the vocabulary is cut to the terms of largest df and texts are matched again, longest
    term first. ``phrases``: the vocabulary is mined for word pairs of high PMI and texts are matched against it.
    The latter two stem queries only, and match queries longest term first. Empty corpora give empty tables, avgdl null.
    """
    if mode not in ("standard", "words", "phrases"):
        raise ValueError(f"unknown mode {mode!r}")
    stop = stop_words(corpus.sparkSession, stopwords)
    again = mode == "phrases" or (mode == "words" and limit > 0)  # texts are matched against a vocabulary
    docs = number_documents(corpus) if again else numbered_counts(corpus, "content")
    if mode == "phrases":
        vocabulary = stage(phrase_vocabulary(docs, "content", min_freq, min_pmi, stop).select("term").distinct(), "vocabulary")
        counts = stage(longest_counts(docs, vocabulary), "counts")
    elif again:
        counts = stage(regex_counts(docs, stop), "counts")
    else:
        counts = listed_counts(docs.select("docid", F.col("content").alias("terms")), stop)
        if mode == "standard" and stemmer != "none":
            counts = stage(stemmed_counts(counts, stemmer), "counts")
    if mode != "standard" and limit > 0:
        kept = stage(top_terms(document_frequencies(counts), limit), "top-terms")
        counts = stage(longest_counts(docs, kept), "counts")
        vocabulary = kept.drop("df").join(document_frequencies(counts), "term")
    else:
        vocabulary = number_rows(document_frequencies(counts), "termid", "term")
    tokenizer = "regex" if mode == "standard" else "longest"
    return assemble(docs, counts, vocabulary, stop, "standard" if mode == "standard" else mode, stemmer, tokenizer)


def build_fielded_index(corpus: DataFrame, fields: tuple[str, ...], stemmer: str = "none", stopwords="none") -> Index:
    """A ``standard`` index of several text columns of corpus(did, fields): searches may be limited to some of them.

    A document's length and a term's df count all fields together.
    """
    stop = stop_words(corpus.sparkSession, stopwords)
    docs = numbered_counts(corpus, *fields)
    parts = [listed_counts(docs.select("docid", F.col(f).alias("terms")), stop).withColumn("fieldid", F.lit(i).cast("long")) for i, f in enumerate(fields)]
    counts = reduce(DataFrame.unionByName, parts)
    if stemmer == "none":
        held = F.array_distinct(F.concat(*(F.transform(f, lambda x: x["term"]) for f in fields)))  # a term of several fields counts once
        per_document = without_words(docs.select("docid", F.explode(held).alias("term")), stop, "term")
    else:
        parts = [stemmed_counts(p.drop("fieldid"), stemmer).withColumn("fieldid", F.lit(i).cast("long")) for i, p in enumerate(parts)]
        counts = stage(reduce(DataFrame.unionByName, parts), "fielded-counts")
        per_document = counts.select("docid", "term").distinct()
    vocabulary = number_rows(document_frequencies(per_document), "termid", "term")
    return assemble(docs, counts, vocabulary, stop, "standard", stemmer, "regex", fields)
