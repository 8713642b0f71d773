"""Word n-grams and phrases by pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import regex_tokens
from ..storage import stage

#: Stop lists up to this length are literals in the plan; longer ones (stopwords.MOST_WORDS at most) are broadcast.
FEW_WORDS = 300


def ngram_array(tokens: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring tokens, joined by a space. No self-join, no shuffle.

    n shifted slices are zipped, so the tokens are worked out a fixed number of times a row, not once a run.
    """
    runs = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    out = F.slice(tokens, F.lit(1), runs)
    for j in range(2, n + 1):
        out = F.zip_with(out, F.slice(tokens, F.lit(j), runs), lambda x, y: F.concat(x, F.lit(" "), y))
    return out


def frequencies(df: DataFrame, items: Column, name: str) -> DataFrame:
    """name, freq, doc_freq of the strings in the array ``items``, a document a row.

    One exchange: every entry goes out once as such and once per document as a distinct one, and both are counted in the
    task before the exchange. Entries are strings, as those alone are told apart by hashing within a row.
    """
    marked = F.concat(F.transform("__items", lambda x: F.struct(x.alias("item"), F.lit(1).alias("f"), F.lit(0).alias("d"))),
                      F.transform(F.array_distinct("__items"), lambda x: F.struct(x.alias("item"), F.lit(0).alias("f"), F.lit(1).alias("d"))))
    rows = df.select(items.alias("__items")).select(F.inline(marked))
    return rows.groupBy(F.col("item").alias(name)).agg(F.sum("f").alias("freq"), F.sum("d").alias("doc_freq"))


def token_frequencies(df: DataFrame, text: str) -> DataFrame:
    """token, freq, doc_freq; empty tokens are counted too."""
    return frequencies(df, regex_tokens(F.col(text)), "token")


def ngram_frequencies(df: DataFrame, text: str, n: int = 2, min_freq: int = 2) -> DataFrame:
    """ngram, freq, doc_freq of all word n-grams occurring at least ``min_freq`` times."""
    return frequencies(df, ngram_array(regex_tokens(F.col(text)), n), "ngram").where(F.col("freq") >= min_freq)


def token_pairs(pairs: DataFrame) -> DataFrame:
    """w1, w2, freq, doc_freq of ngram, freq, doc_freq: no token holds a space, so the first one parts the two."""
    return pairs.select(F.substring_index("ngram", " ", 1).alias("w1"), F.expr("substring(ngram, instr(ngram, ' ') + 1)").alias("w2"), "freq", "doc_freq")


def bigram_frequencies(df: DataFrame, text: str, min_freq: int = 2) -> DataFrame:
    """w1, w2, freq, doc_freq of neighbouring tokens, empty ones included."""
    return token_pairs(ngram_frequencies(df, text, 2, min_freq))


def tokenized(df: DataFrame, text: str) -> DataFrame:
    """tokens of every row, worked out once and staged for those that count them several times."""
    return stage(df.select(regex_tokens(F.col(text)).alias("tokens")), "tokens")


def scored_pairs(tokens: DataFrame, single: DataFrame, min_freq: int, min_pmi: float) -> DataFrame:
    """w1, w2, pmi, df of the neighbouring tokens with freq >= min_freq and PMI >= min_pmi (base 2); single(token, freq)."""
    pairs = token_pairs(frequencies(tokens, ngram_array(F.col("tokens"), 2), "ngram").where(F.col("freq") >= min_freq))
    total = single.agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("double").alias("total"))
    for w, f in (("w1", "f1"), ("w2", "f2")):
        pairs = pairs.join(single.select(F.col("token").alias(w), F.col("freq").alias(f)), w)
    pmi = F.log10(F.col("freq") * F.col("total") / (F.col("f1").cast("double") * F.col("f2"))) / F.log10(F.lit(2.0))
    scored = pairs.crossJoin(F.broadcast(total)).select("w1", "w2", pmi.alias("pmi"), F.col("doc_freq").alias("df"))  # one row
    return scored.where(F.col("pmi") >= min_pmi)


def pmi_phrases(df: DataFrame, text: str, min_freq: int = 2, min_pmi: float = 3.0) -> DataFrame:
    """phrase, pmi, df of the word pairs with freq >= min_freq and PMI >= min_pmi (base 2)."""
    tokens = tokenized(df, text)
    single = stage(frequencies(tokens, F.col("tokens"), "token"), "token-frequencies")
    return scored_pairs(tokens, single, min_freq, min_pmi).select(F.concat_ws(" ", "w1", "w2").alias("phrase"), "pmi", "df")


def without_words(df: DataFrame, words: list[str] | None, *columns: str) -> DataFrame:
    """The rows with none of ``words`` in the columns: tested in place, a long list by anti joins."""
    if words and len(words) > FEW_WORDS:
        listed = F.broadcast(df.sparkSession.createDataFrame([(w,) for w in words], "__word string"))
        for c in columns:
            df = df.join(listed, F.col(c) == F.col("__word"), "left_anti")
    elif words:
        for c in columns:
            df = df.where(~F.col(c).isin(*words))
    return df


def phrase_vocabulary(df: DataFrame, text: str, min_freq: int = 10, min_pmi: float = 5.0, stopwords: list[str] | None = None) -> DataFrame:
    """term, df: phrases without a stop word, then non-empty words that are no stop words and occur min_freq times."""
    tokens = tokenized(df, text)
    single = stage(frequencies(tokens, F.col("tokens"), "token"), "token-frequencies")
    phrases = without_words(scored_pairs(tokens, single, min_freq, min_pmi), stopwords, "w1", "w2")
    words = without_words(single.where((F.col("freq") >= min_freq) & (F.col("token") != "")), stopwords, "token")
    return phrases.select(F.concat_ws(" ", "w1", "w2").alias("term"), "df").unionByName(words.select(F.col("token").alias("term"), F.col("doc_freq").alias("df")))
