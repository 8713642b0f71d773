"""Index transforms. Each gives a new index; the old one stays as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stemmers import stem
from ..index import Index
from ..storage import number_rows, running_sum, stage


def with_priors(index: Index, priors: DataFrame | None = None, default: float | None = None, init: str | None = None) -> Index:
    """Adds docs.prior from priors(did, prior), from ``init`` ("len" or "uniform"), else null.

    Documents absent from the priors get ``default``, null without one: their scores are then null.
    """
    if init not in (None, "len", "uniform"):
        raise ValueError(f"unknown prior {init!r}")
    if priors is not None:
        given = priors.select(F.col("did").cast("string").alias("name"), F.col("prior").cast("double").alias("prior"))
        docs = index.docs.drop("prior").join(given, "name", "left")
        docs = docs.withColumn("prior", F.coalesce("prior", F.lit(default).cast("double")))
    else:
        value = {"len": F.col("len").cast("double"), "uniform": F.lit(1.0), None: F.lit(None).cast("double")}[init]
        docs = index.docs.withColumn("prior", value)
    return index.with_(docs=docs)


def renumbered(index: Index, column: str = "prior") -> Index:
    """Document ids by falling ``column``, then name; postings follow."""
    docs = number_rows(index.docs.withColumnRenamed("docid", "old"), "docid", F.desc(column), F.asc("name"))
    ids = docs.select("old", "docid")
    postings = index.postings.withColumnRenamed("docid", "old").join(ids, "old").select("termid", "docid", "fieldid", "tf")
    first = ["docid", "name"]
    docs = docs.select(*first, *(c for c in index.docs.columns if c not in first))
    return index.with_(docs=docs, postings=postings, stats=index.stats.withColumn("index_type", F.lit("fitted")))


def sample_by_values(docs: DataFrame, column: str, threshold: float = 0) -> DataFrame:
    """(x, y) per distinct value over the threshold: log of the number of documents with at least it, log of the value."""
    counts = docs.where(F.col(column) > threshold).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return running_sum(counts, "n", "at_least", F.desc("v")).select(F.log("at_least").alias("x"), F.log("v").alias("y"))


def bins(index: Index, total: int) -> DataFrame:
    """(low, mid, high): ``total`` equal widths of the log of the id, the first widened to begin at 0."""
    width = F.lit(float(index.about.num_docs + 1))
    step = F.log(width) / F.lit(float(total + 2))
    at = index.docs.sparkSession.range(2, total + 2).withColumn("nr", F.col("id").cast("double"))
    low = F.when(F.col("nr") == 2, F.lit(0.0)).otherwise(F.col("nr") * step)
    high = (F.col("nr") + 1) * step
    return at.select(low.alias("low"), ((low + high) / 2).alias("mid"), high.alias("high"))


def _binned(docs: DataFrame, index: Index, total: int) -> DataFrame:
    """Each document with its bin: the bins are ``total`` rows, so they are sent to the documents."""
    b, x = F.broadcast(bins(index, total)), F.log(F.col("docid") + 1)
    return docs.join(b, (x >= F.col("low")) & (x < F.col("high")))


def sample_by_fixed_points(index: Index, column: str, threshold: float = 0, total: int = 20) -> DataFrame:
    """(x, y) per bin with documents over the threshold: its middle, and the log of their mean value."""
    rows = _binned(index.docs.where(F.col(column) > threshold), index, total)
    return rows.groupBy("mid").agg(F.avg(column).alias("y")).select(F.col("mid").alias("x"), F.log("y").alias("y"))


def sample_by_qrels(index: Index, qrels: DataFrame, total: int = 20) -> DataFrame:
    """(x, y) per bin with judged relevant documents: its middle, and the log of their density."""
    relevant = qrels.where("rel > 0").select(F.col("docno").cast("string").alias("name"))
    rows = _binned(relevant.join(index.docs, "name"), index, total)
    found = rows.groupBy("low", "mid", "high").agg(F.count("*").alias("n"))
    return found.select(F.col("mid").alias("x"), F.log(F.col("n") / (F.exp("high") - F.exp("low"))).alias("y"))


def fit_line(sample: DataFrame) -> DataFrame:
    """One row (slope, intercept): least squares; a rising slope becomes 0 and leaves the intercept. Nulls without two distinct x."""
    fit = sample.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return fit.select(F.when(F.col("slope") > 0, F.lit(0.0)).otherwise(F.col("slope")).alias("slope"), "intercept")


def fitted(index: Index, column: str = "prior", total: int | None = None, threshold: float = 0, qrels: DataFrame | None = None) -> Index:
    """Replaces ``column`` ("len" or "prior") by a line through its logarithm over the log of the rank."""
    if column not in ("len", "prior"):
        raise ValueError(f"cannot fit {column!r}")
    if qrels is not None and not total:
        raise ValueError("judgments need a number of bins")
    new = renumbered(index, column)
    new = new.with_(docs=stage(new.docs, "fitted"))
    if qrels is not None:
        sample = sample_by_qrels(new, qrels, total)
    elif total:
        sample = sample_by_fixed_points(new, column, threshold, total)
    else:
        sample = sample_by_values(new.docs, column, threshold)
    return new.with_(docs=new.docs.drop(column), stats=new.stats.join(fit_line(sample)))


def constant_length(index: Index, const_len: int = 400, b: float = 1.0, keep_terms: bool = False, maxp: float = 1.0) -> Index:
    """Postings as if all documents had one length: tf is normalised, rounded and capped; df, sumdf and avgdl stay."""
    norm = F.col("tf") / (F.lit(1.0 - b) + F.lit(float(b)) * F.col("len") / F.lit(float(const_len)))
    new = norm - 0.5
    if keep_terms:
        new = F.when(norm > 0.5, new).otherwise(F.lit(0.1))
    rows = index.postings.join(index.docs.select("docid", "len"), "docid")
    tf = F.least(F.ceil(new), F.lit(int(const_len * maxp))).cast("long")
    postings = rows.withColumn("tf", tf).where("tf > 0").select("termid", "docid", "fieldid", "tf")
    kind = f"const(len={const_len},b={b:g})"
    stats = index.stats.withColumns({"index_type": F.lit(kind), "const_len": F.lit(const_len).cast("long")})
    return index.with_(postings=postings, docs=index.docs.drop("len"), stats=stats)


def grouped(index: Index, stemmer="porter") -> Index:
    """Terms of one stem share an id and a df; every surface term stays in the dictionary, sumdf stays too.

    ``stemmer`` is a name, or a function from a column to a column. Ids follow the order of the stems.
    """
    s = stemmer(F.col("term")) if callable(stemmer) else stem(F.col("term"), stemmer)
    terms = stage(index.dict.select(F.col("termid").alias("old"), "term", s.alias("stem")), "stems")
    classes = number_rows(terms.select("stem").distinct(), "termid", "stem")
    terms = terms.join(classes, "stem")
    postings = index.postings.withColumnRenamed("termid", "old").join(terms.select("old", "termid"), "old")
    postings = stage(postings.groupBy("termid", "docid", "fieldid").agg(F.sum("tf").alias("tf")), "grouped")
    per_doc = postings if not index.has_many_fields else postings.select("termid", "docid").distinct()
    df = per_doc.groupBy("termid").agg(F.count("*").alias("df"))
    name = stemmer if isinstance(stemmer, str) else stemmer.__name__
    return index.with_(dict=terms.join(df, "termid").select("termid", "term", "df"), postings=postings, stats=index.stats.withColumn("index_type", F.lit(f"grouped({name})")))


