"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all words of the labelled sample and the five-letter stems of longer words. A term's weight is its inverse
document frequency, which counts all documents, times its association with the label in the sample (chi-square), which is
never 0; words that no example has add nothing to a cosine and are left out of a text's length. The examples lie in an
inverted index in blocks; per term and block the largest weight is known. The most frequent terms are multiplied as one
matrix for many queries at a time, which also gives a k-th best cosine to begin with; of the others a query scores only the
blocks whose bound exceeds it. The best are worked out again in double precision, so the neighbours are exact
for the index's weights, which are kept in single precision. Votes are weighted by nearness and class frequency, then
calibrated on the examples' own left-one-out votes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_hashed, stage
from .words import id_text, letter_words, public_id, slices

#: The classifier is fitted on at most so many labelled rows of each class, those with the least hashes of id and text, and
#: on at most SAMPLE_BYTES of text.
ROWS_PER_CLASS, SAMPLE_BYTES = {1: 2000, 0: 4000}, 64 << 20
#: A term weighs LEAST_WEIGHT, and one more as its chi-square grows; half of that at HALF_CHI2.
LEAST_WEIGHT, HALF_CHI2 = 0.1, 20.0
BLOCK, NEIGHBOURS = 256, 15
#: Terms that more than one in DENSE examples have, at most MOST_DENSE of them, are multiplied as a matrix, BATCH queries at a time.
DENSE, MOST_DENSE, BATCH = 16, 1024, 64
#: More than single precision can be off by.
SLACK = 1e-5
STEM = 5
CACHE_QUERIES = 50_000


def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after the other."""
    size = stop - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Terms:
    """Numbers of words and of the stems of longer words, which end in '*'. New terms are numbered while ``learning``."""

    def __init__(self, vocabulary: dict[str, int], learning: bool = False) -> None:
        self.vocabulary, self.learning = vocabulary, learning

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(terms in order, their frequencies) of a text."""
        found = Counter(letter_words(text.lower()))
        words = list(found)
        long = [w for w in words if len(w) > STEM]
        stems = [w[:STEM] + "*" for w in long]
        if self.learning:
            for w in chain(words, stems):
                self.vocabulary.setdefault(w, len(self.vocabulary))
        n = np.fromiter(chain(found.values(), map(found.__getitem__, long)), np.int64, len(words) + len(long))
        t = np.fromiter(map(self.vocabulary.get, chain(words, stems), repeat(-1)), np.int64, len(n))
        t, at = np.unique(t, return_inverse=True)
        n = np.bincount(at, n, len(t)).astype(np.int64)
        return (t[1:], n[1:]) if len(t) and t[0] < 0 else (t, n)


def association(p: np.ndarray, q: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Weights above 0 of terms in ``p`` of the toxic and ``q`` of the other examples, by their chi-square."""
    if not pos or not neg:
        return np.ones(len(p))
    n = pos + neg
    chi2 = n * (p * (neg - q) - q * (pos - p)) ** 2 / np.maximum(1e-9, (p + q) * (n - p - q) * pos * neg)
    return LEAST_WEIGHT + chi2 / (chi2 + HALF_CHI2)


def unit(t: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) at length one of terms in order and their frequencies."""
    w = (1 + np.log(n)) * idf[t]
    size = np.sqrt(w @ w)
    return (t, w / size) if size > 0 else (t[:0], w[:0])


def weighted(tf: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``unit`` of a dictionary."""
    t = np.array(sorted(tf), np.int64)
    return unit(t, np.array([tf[i] for i in t.tolist()], np.float64), idf)


class Index:
    """Block-max inverted index over labelled examples; ``idf`` weighs the terms."""

    def __init__(self, examples: list[tuple[int, int, dict[int, int] | tuple[np.ndarray, np.ndarray]]], idf: np.ndarray, class_weight: dict[int, float]) -> None:
        rows = []
        for doc, y, tf in examples:
            t, w = weighted(tf, idf) if isinstance(tf, dict) else unit(*tf, idf)
            rows.append((doc, y, t.astype(np.int32), w.astype(np.float32)))
        rows.sort(key=lambda r: (int(r[2][r[3].argmax()]), -float(r[3].max()), r[0]) if len(r[2]) else (len(idf), 0.0, r[0]))  # like next to like: tight bounds
        self.docs = [r[0] for r in rows]
        self.y = np.array([r[1] for r in rows], np.float64)
        self.mass = np.array([class_weight[r[1]] for r in rows])
        self.idf, self.rows = idf, rows
        n, v = len(rows), len(idf)
        self.blocks = -(-n // BLOCK)
        term = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(n, dtype=np.int32), [len(r[2]) for r in rows]) if rows else term
        weight = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.float32)
        # frequent terms as a matrix, a column a term
        size = np.bincount(term, minlength=v)
        often = np.flatnonzero(size > n / DENSE)
        often = np.sort(often[np.argsort(-size[often], kind="stable")[:MOST_DENSE]])
        self.row = np.full(v, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.full = np.zeros((self.blocks * BLOCK, len(often)), np.float32)
        at = self.row[term]
        self.full[doc[at >= 0], at[at >= 0]] = weight[at >= 0]
        # the others as lists by term, then example; a list has a part for every block that holds its term
        rare = np.flatnonzero(at < 0)
        rare = rare[np.argsort(term[rare], kind="stable")]
        term, doc, weight = term[rare], doc[rare], weight[rare]
        self.posting = np.empty(len(term), np.dtype([("doc", np.int32), ("weight", np.float32)]))  # side by side: one fetch
        self.posting["doc"], self.posting["weight"] = doc, weight
        cell = term.astype(np.int64) * max(1, self.blocks) + doc // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.part, self.block = np.append(first, len(cell)).astype(np.int32), (doc[first] // BLOCK).astype(np.int32)
        self.best = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0, np.float32)
        self.start = np.searchsorted(term[first], np.arange(v + 1)).astype(np.int32)

    def add(self, cos: np.ndarray, part: np.ndarray, x: np.ndarray) -> None:
        """Adds what the given parts of lists make, of terms with weights ``x`` in the query. Neighbouring parts are read as one."""
        if not len(part):
            return
        first = np.flatnonzero((np.diff(part, prepend=-2) != 1) | (np.diff(x, prepend=-1.0) != 0))
        a, b = self.part[part[first]], self.part[part[np.append(first[1:], len(part)) - 1] + 1]
        found = self.posting.view(np.int64)[spans(a, b)].view(self.posting.dtype)
        cos += np.bincount(found["doc"], np.repeat(x[first], b - a) * found["weight"], len(cos))

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.all_nearest([(t, w)], k, [skip])[0]

    def all_nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights): (examples, cosines) of the k nearest with a cosine above 0; ties go to the earlier example."""
        out = []
        for a in range(0, len(queries), BATCH):
            part = queries[a : a + BATCH]
            q = np.zeros((len(part), self.full.shape[1]), np.float32)
            for i, (t, w) in enumerate(part):
                row = self.row[t]
                q[i, row[row >= 0]] = w[row >= 0]
            dense = q @ self.full.T
            out += [self.refined(t, w, dense[i], k, -1 if skip is None else skip[a + i]) for i, (t, w) in enumerate(part)]
        return out

    def refined(self, t: np.ndarray, w: np.ndarray, dense: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """``nearest``, given what the frequent terms make."""
        if not len(t) or not self.docs:
            return np.zeros(0, np.int64), np.zeros(0)
        row = self.row[t]
        common = row >= 0
        a, b = self.start[t], self.start[t + 1]
        part, x = spans(a, b), np.repeat(w, b - a)
        block = self.block[part]
        bound = np.bincount(block, x * self.best[part], self.blocks) + dense.reshape(self.blocks, BLOCK).max(axis=1)
        if skip >= 0:
            dense[skip] = 0
        cos = dense.astype(np.float64)
        # what the frequent terms alone make is already a floor; blocks that cannot exceed it keep their part of the cosine
        floor = np.partition(cos, len(cos) - k)[len(cos) - k] if len(cos) > k else 0.0
        open_blocks = (bound > 0) & (bound >= floor - SLACK)
        if not open_blocks.all():
            use = open_blocks[block]
            part, x = part[use], x[use]
        self.add(cos, part, x)
        if skip >= 0:
            cos[skip] = 0
        floor = np.partition(cos, len(cos) - k)[len(cos) - k] if len(cos) > k else 0.0
        near = np.flatnonzero((cos >= floor - SLACK) & (cos > 0))
        exact = cos[near] - dense[near] + self.full[np.ix_(near, row[common])].astype(np.float64) @ w[common]
        exact = np.round(np.minimum(exact, 1.0), 12)
        top = np.lexsort((near, -exact))[:k]
        top = top[exact[top] > 0]
        return near[top], exact[top]

    def vote(self, near: np.ndarray, cos: np.ndarray, prior: float) -> float:
        """Share of toxic votes; one vote for the base rate keeps weak evidence weak."""
        w = self.mass[near] * cos**2 / (1.05 - cos)
        return float((w @ self.y[near] + prior) / (w.sum() + 1.0))


def calibrate(votes: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve on the log-odds of left-one-out votes."""
    x = np.log(votes / (1 - votes))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = mass * (p - y), mass * p * (1 - p) + 1e-9
        g = np.array([r @ x + 0.01 * (a - 1), r.sum() + 0.01 * b])
        m = np.array([[h @ (x * x) + 0.01, h @ x], [h @ x, h.sum() + 0.01]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 0.05), b


def counted(shared):
    """Document frequencies of the vocabulary, one row per term and task; term -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, documents = shared.value, 0
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            documents += batch.num_rows
            for part in slices(batch):
                found: Counter = Counter()
                for t in part.column("text").to_pylist():
                    words = set(letter_words(t.decode("utf-8", "replace").lower()))
                    found.update(words)
                    found.update({w[:STEM] + "*" for w in words if len(w) > STEM})
                at = np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int64, len(found))
                n = np.fromiter(found.values(), np.int64, len(found))
                df[at[at >= 0]] += n[at >= 0]
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, terms)), pa.array(np.append(documents, df[terms]))], names=["term", "n"])

    return run


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int], id_col: str, text_col: str) -> np.ndarray:
    """Documents that have each term of the sample's vocabulary, which is bounded as the sample is; the last entry counts all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    found = id_text(docs, id_col, text_col).mapInArrow(counted(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return df


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Fit on labelled rows with crc32(id as text) mod 5 other than 0; their texts, of a bounded sample, come to the driver.

    Rows are told apart by id and text, so repeated ids bring no more than the sample's rows.
    """
    spark = docs.sparkSession
    y = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    y = y.where(F.crc32(F.col("id").cast("string")) % 5 != 0).groupBy("id").agg(F.max("y").alias("y"))
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("key", F.xxhash64("id", "t"))
    labelled = stage(x.select("id", "key", F.octet_length("t").alias("bytes")).join(y, "id").select("key", F.col("y").alias("cls"), "bytes"), "labelled")
    total = {r.cls: r["count"] for r in labelled.groupBy("cls").count().collect()}
    chosen = spark.createDataFrame(least_hashed(labelled, ROWS_PER_CLASS, total, SAMPLE_BYTES), "key long, y int").dropDuplicates(["key"])
    rows = x.join(F.broadcast(chosen), "key").groupBy("key", "y").agg(F.min("id").alias("id"), F.min("t").alias("t")).collect()  # at most sum(ROWS_PER_CLASS)
    rows.sort(key=lambda r: (r.id, r.key))
    terms = Terms({}, learning=True)
    samples = [(r.id, r.y, tuple(z.astype(np.int32) for z in terms.of(r.t))) for r in rows]
    rows, vocabulary = [], terms.vocabulary
    known = len(vocabulary)
    df = document_frequencies(docs, vocabulary, id_col, text_col)
    with_term = {c: np.zeros(known) for c in (0, 1)}
    for _, y, (t, _) in samples:
        with_term[y][t] += 1
    have = Counter(y for _, y, _ in samples)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * association(with_term[1], with_term[0], have[1], have[0])
    size = max(1, sum(total.values()))
    prior = min(0.49, max(0.001, total.get(1, 0) / size))
    weight = {c: total.get(c, 0) / size / max(1, have[c]) * max(1, len(samples)) for c in (0, 1)}
    index = Index(samples, idf, weight)
    near = index.all_nearest([(r[2], r[3].astype(np.float64)) for r in index.rows], skip=list(range(len(index.rows))))
    votes = np.array([index.vote(*x, prior) for x in near])
    curve = calibrate(votes, index.y, index.mass) if len(votes) and 0 < index.y.sum() < len(votes) else (1.0, 0.0)
    index.rows = []
    return {"vocabulary": vocabulary, "index": index, "prior": prior, "curve": curve}


def scores_of(model: dict, texts: list[str], terms: Terms, cache: dict) -> list[tuple[float, str]]:
    """(score, evidence) of each text: evidence names the nearest examples as doc_id:cosine:label."""
    if len(cache) > CACHE_QUERIES:
        cache.clear()
    keys = [xxhash.xxh128_digest(t.encode("utf-8", "replace")) for t in texts]
    fresh = {k: t for k, t in zip(keys, texts, strict=True) if k not in cache}
    index, (a, b) = model["index"], model["curve"]
    for k, (near, cos) in zip(fresh, index.all_nearest([unit(*terms.of(t), index.idf) for t in fresh.values()]), strict=True):
        p = index.vote(near, cos, model["prior"])
        score = float(1 / (1 + np.exp(-np.clip(a * np.log(p / (1 - p)) + b, -30, 30)))) if len(near) else model["prior"]
        cache[k] = (score, ",".join(f"{index.docs[i]}:{c:.4f}:{int(index.y[i])}" for i, c in zip(near[:3].tolist(), cos[:3].tolist(), strict=True)))
    return [cache[k] for k in keys]


def scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        terms, cache = Terms(model["vocabulary"]), {}
        for batch in batches:
            for part in slices(batch):
                got = scores_of(model, [t.decode("utf-8", "replace") for t in part.column("text").to_pylist()], terms, cache)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.string())], names=["doc", "score", "evidence"])

    return run


def toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, evidence.

    Null and empty texts, and texts without a word of any example, score the base rate of the labels (kept below
    0.5); without labels of both classes every text does. Very long texts are scored whole; of equally near examples the earlier one
    of the index counts. A null id is neither held out nor learned from; repeated rows score
    alike; a document with contradicting labels counts as toxic; an empty table gives an empty result; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = id_text(docs, id_col, text_col).mapInArrow(scored(shared), "doc long, score double, evidence string")
    held = F.coalesce(F.crc32(public_id(F.col("doc")).cast("string")) % 5 == 0, F.lit(False))
    return rows.select(public_id(F.col("doc")).alias("doc_id"), held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
