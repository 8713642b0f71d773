"""Language identification by a linear-chain conditional random field over words.

Features of a word: its character 2- and 3-grams with its borders, affixes of three letters, and its entry in
lexicons of frequent words. Transitions between the languages of neighbouring words are learned too, on sequences spliced
from documents of different languages, so code-switched texts get a label per word. Forward-backward
gives the posterior of every word; a document's language is the one with the largest mean posterior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_hashed
from .words import id_text, letter_words, public_id, slices

#: The classifier is fitted on at most DOCS_PER_LANG labelled rows a language, those with the least hashes of id and text;
#: on fewer a language, but one at least, where that would be over SAMPLE_ROWS rows or SAMPLE_BYTES bytes in all.
DOCS_PER_LANG, SAMPLE_ROWS, SAMPLE_BYTES = 300, 19_200, 96 << 20
LEXICON = 1500
#: Feature buckets, and weights of a model: buckets times languages. The buckets are halved until that holds.
BUCKETS, MOST_WEIGHTS = 1 << 16, 1 << 22
SEQUENCES, LENGTH, EPOCHS = 3000, 48, 12
CACHE_WORDS = 300_000
#: Words times languages worked through at a time; a longer text goes by segments.
CELLS = 1_600_000
START, END = 2, 3


class Emissions(dict):
    """As a dict: row of a word in ``scores``; rows of new words are computed together by ``settle``."""

    def __init__(self, weights: np.ndarray, lexicon: dict[str, int]) -> None:
        self.weights, self.lexicon, self.fresh = weights, lexicon, []
        self.scores = np.zeros((4096, weights.shape[1]), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.fresh.append(word)
        return i

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def settle(self) -> None:
        if not self.fresh:
            return
        at, words = features(self.fresh, self.lexicon, len(self.weights))
        n = len(self)
        if n > len(self.scores):
            grown = np.zeros((max(n, 2 * len(self.scores)), self.scores.shape[1]), np.float32)
            grown[: len(self.scores)] = self.scores
            self.scores = grown
        self.scores[n - len(self.fresh) : n] = np.add.reduceat(self.weights[at], words)
        self.fresh = []


def features(words: list[str], lexicon: dict[str, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of the words, one after another, and where each word's begin."""
    c = np.frombuffer("".join(["\x02" + w + "\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words])
    begin = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(words)), length)
    nxt, third, fourth = (np.concatenate([c[k:], np.zeros(k, np.uint64)]) for k in (1, 2, 3))
    mult = np.uint64(0x9E3779B97F4A7C15)

    def bucket(kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(len(parts[0]), kind, np.uint64)
        for p in parts:
            h = (h ^ p) * mult
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(40)).astype(np.int64) % buckets

    place = np.arange(len(c)) - begin[owner]
    left = length[owner] - place  # characters from here to the end of the word, border included
    two, three = left >= 2, left >= 3
    affix = (left >= 4) & ((place == 0) | (left == 4))
    kinds = [(two, bucket(11, c, nxt)), (three, bucket(12, c, nxt, third)), (affix, bucket(13, c, nxt, third, fourth))]
    own = [owner[m] for m, _ in kinds]
    at = [b[m] for m, b in kinds]
    entry = np.array([lexicon.get(w, 0) for w in words], np.int64) % buckets  # 0: in no lexicon, also a feature
    at.append(entry)
    own.append(np.arange(len(words)))
    own_all, at_all = np.concatenate(own), np.concatenate(at)
    order = np.argsort(own_all, kind="stable")
    starts = np.searchsorted(own_all[order], np.arange(len(words)))
    return at_all[order], starts


def forward_backward(x: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors [n, T, K] of rows in order of falling length, and pair expectations [K, K]; x: exponentiated emissions."""
    n, t_max, k = x.shape
    live = np.searchsorted(-lengths, -np.arange(t_max), "left")  # rows longer than t
    a, b = np.ones_like(x), np.ones_like(x)
    row = x[:, 0] / x[:, 0].sum(axis=1, keepdims=True)
    a[:, 0] = row
    for t in range(1, t_max):
        m = live[t]
        row = (row[:m] @ trans) * x[:m, t]
        row /= row.sum(axis=1, keepdims=True)
        a[:m, t] = row
    for t in range(t_max - 2, -1, -1):
        m = live[t + 1]
        row = (x[:m, t + 1] * b[:m, t + 1]) @ trans.T
        row /= row.sum(axis=1, keepdims=True)
        b[:m, t] = row
    post = a * b
    post /= post.sum(axis=2, keepdims=True)
    return post, (a, b)


def pair_expectations(x: np.ndarray, a: np.ndarray, b: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected transitions of rows of one length."""
    right = x[:, 1:] * b[:, 1:]
    z = np.einsum("nti,ij,ntj->nt", a[:, :-1], trans, right)
    return trans * np.einsum("nti,ntj->ij", a[:, :-1] / z[..., None], right)


def fit(samples: list[tuple[str, str]]) -> dict:
    """Weights from (lang, text) pairs."""
    langs = sorted({lang for lang, _ in samples})
    texts = {lang: [w for lang2, t in samples if lang2 == lang and (w := letter_words(t.lower()))] for lang in langs}
    langs = [lang for lang in langs if texts[lang]]
    k, buckets = len(langs), BUCKETS
    while buckets * k > MOST_WEIGHTS and buckets > 1024:
        buckets //= 2
    if k == 0:
        return {"langs": [], "weights": np.zeros((BUCKETS, 1), np.float32), "trans": np.ones((1, 1)), "lexicon": {}}
    lexicon: dict[str, int] = {}
    for lang in langs:
        for w, _ in Counter(chain.from_iterable(texts[lang])).most_common(LEXICON):
            lexicon.setdefault(w, 1 + len(lexicon))
    rng = np.random.default_rng(7)
    seqs, labels = [], []
    for _ in range(SEQUENCES):
        words: list[str] = []
        tags: list[int] = []
        spans = int(rng.integers(1, 4))
        while len(words) < LENGTH:
            lang = int(rng.integers(k))
            doc = texts[langs[lang]][int(rng.integers(len(texts[langs[lang]])))]
            a = int(rng.integers(len(doc)))
            part = doc[a : a + max(1, LENGTH // spans)]
            words += part
            tags += [lang] * len(part)
        seqs.append(words[:LENGTH])
        labels.append(tags[:LENGTH])
    y = np.array(labels)
    index: dict[str, int] = {}
    ids = np.array([[index.setdefault(w, len(index)) for w in s] for s in seqs])
    at, starts = features(list(index), lexicon, buckets)
    counts = np.diff(np.append(starts, len(at)))
    weights, trans = np.zeros((buckets, k)), np.zeros((k, k))
    gw, gt = np.full((buckets, k), 1e-6), np.full((k, k), 1e-6)
    onehot = np.eye(k)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(seqs)), 10):
            own, inverse = np.unique(ids[part], return_inverse=True)
            mine = np.concatenate([at[s : s + c] for s, c in zip(starts[own], counts[own], strict=True)])
            begin = np.cumsum(counts[own]) - counts[own]
            scores = np.add.reduceat(weights[mine], begin)
            e = scores[inverse.reshape(len(part), LENGTH)]
            x = np.exp(e - e.max(axis=2, keepdims=True))
            et = np.exp(trans)
            post, (a, b) = forward_backward(x, np.full(len(part), LENGTH), et)
            tags = y[part]
            d = (onehot[tags] - post).reshape(-1, k)
            by_word = np.stack([np.bincount(inverse.ravel(), d[:, j], len(own)) for j in range(k)], axis=1)
            spread = np.repeat(by_word, counts[own], axis=0)
            g = np.stack([np.bincount(mine, spread[:, j], buckets) for j in range(k)], axis=1) / len(part) - 1e-6 * weights
            seen = np.zeros((k, k))
            np.add.at(seen, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
            h = (seen - pair_expectations(x, a, b, et)) / len(part)
            gw += g * g
            gt += h * h
            weights += 0.15 * g / np.sqrt(gw)
            trans += 0.1 * h / np.sqrt(gt)
    return {"langs": langs, "weights": weights.astype(np.float32), "trans": np.exp(trans), "lexicon": lexicon}


def label_words(model: dict, words: list[str]) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of one text: for code-switched texts."""
    if not words or not model["langs"]:
        return []
    e = Emissions(model["weights"], model["lexicon"])
    rows = e.rows([w.lower() for w in words])
    e.settle()
    s = e.scores[rows][None].astype(np.float64)
    post = forward_backward(np.exp(s - s.max(axis=2, keepdims=True)), np.array([len(words)]), model["trans"])[0][0]
    return [(w, model["langs"][int(p.argmax())], float(p.max())) for w, p in zip(words, post, strict=True)]


def segmented(e: Emissions, ids: np.ndarray, trans: np.ndarray, size: int) -> np.ndarray:
    """Mean posterior of one long text: messages are kept at the borders of segments of ``size`` words and worked out again inside."""
    def emitted(a: int, b: int) -> np.ndarray:
        s = e.scores[ids[a:b]].astype(np.float64)
        return np.exp(s - s.max(axis=1, keepdims=True))

    starts = range(0, len(ids), size)
    before, row = [], None  # the forward message that enters each segment
    for a in starts:
        before.append(row)
        for x in emitted(a, a + size):
            row = x if row is None else (row @ trans) * x
            row = row / row.sum()
    total, after = np.zeros(trans.shape[0]), None  # the backward message that enters each segment from behind
    for a, row in zip(reversed(starts), reversed(before), strict=True):
        x = emitted(a, a + size)
        forward = np.empty_like(x)
        for t in range(len(x)):
            row = x[t] if row is None else (row @ trans) * x[t]
            forward[t] = row = row / row.sum()
        b = np.ones(trans.shape[0]) if after is None else after
        for t in range(len(x) - 1, -1, -1):
            post = forward[t] * b
            total += post / post.sum()
            b = trans @ (x[t] * b)
            b = b / b.sum()
        after = b
    return total / len(ids)


def posteriors(model: dict, e: Emissions, texts: list[str]) -> np.ndarray:
    """Mean posterior of each language by text; rows of zeros without words."""
    k = len(model["langs"])
    out = np.zeros((len(texts), k))
    if len(e) > CACHE_WORDS:
        e.clear()
    ids = [e.rows(letter_words(t.lower())) for t in texts]
    e.settle()
    order = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: -len(ids[i]))
    at, most = 0, max(1, CELLS // k)
    while at < len(order):
        longest = len(ids[order[at]])
        if longest > most:
            out[order[at]] = segmented(e, ids[order[at]], model["trans"], most)
            at += 1
            continue
        part = order[at : at + min(512, most // longest)]
        at += len(part)
        lengths = np.array([len(ids[i]) for i in part])
        x = np.ones((len(part), longest, k))
        for r, i in enumerate(part):
            s = e.scores[ids[i]]
            x[r, : len(s)] = np.exp(s - s.max(axis=1, keepdims=True))
        post, _ = forward_backward(x, lengths, model["trans"])
        for r, i in enumerate(part):
            out[i] = post[r, : lengths[r]].mean(axis=0)
    return out


def predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        e = Emissions(model["weights"], model["lexicon"])
        for batch in batches:
            for part in slices(batch, limit=6 << 20):
                texts = [t.decode("utf-8", "replace") for t in part.column("text").to_pylist()]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if model["langs"]:
                    mean = posteriors(model, e, texts)
                    best = mean.argmax(axis=1)
                    for i, b in enumerate(best.tolist()):
                        if mean[i].any():
                            langs[i], scores[i] = model["langs"][b], min(1.0, float(mean[i, b]))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc", "lang_pred", "score"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Fit on labelled rows with crc32(id as text) mod 3 other than 1; the texts of a bounded sample come to the driver.

    Every value of lang is learned. Rows are told apart by id and text, so repeated ids bring no more than the sample's rows.
    """
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    x = x.where((F.crc32(F.col("id").cast("string")) % 3 != 1) & F.col("lang").isNotNull() & F.col("t").isNotNull())
    counts = {r.lang: r["count"] for r in x.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    x = x.withColumn("key", F.xxhash64("id", "t"))
    each = max(1, min(DOCS_PER_LANG, SAMPLE_ROWS // len(counts)))
    rows = x.select("key", F.col("lang").alias("cls"), F.octet_length("t").alias("bytes"))
    chosen = least_hashed(rows, dict.fromkeys(counts, each), counts, SAMPLE_BYTES)
    keys = docs.sparkSession.createDataFrame(sorted(set(chosen)), "key long, lang string")  # at most SAMPLE_ROWS, or one a language
    rows = x.join(F.broadcast(keys), ["key", "lang"]).groupBy("key", "lang").agg(F.min("t").alias("t")).collect()
    return fit([(r.lang, r.t) for r in sorted(rows, key=lambda r: (r.lang, r.key))])


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0; very long texts are labelled whole, by segments; of equal
    posteriors the language first by name is taken; a null id is never held out nor learned
    from; repeated rows are predicted alike; without any labelled row all are ``und``; an empty table gives an
    empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = id_text(docs, id_col, text_col).mapInArrow(predicted(shared), "doc long, lang_pred string, score double")
    held = F.coalesce(F.crc32(public_id(F.col("doc")).cast("string")) % 3 == 1, F.lit(False))
    return rows.select(public_id(F.col("doc")).alias("doc_id"), held.alias("held_out"), "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
