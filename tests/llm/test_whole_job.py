"""Cases in which an operator once did less than its whole job."""

import random
import string
import zlib

import numpy as np

import cases
from quern.llm import secrets, toxicity


def test_toxicity_keeps_all_terms_and_examples(spark):
    """Words too rare for a chi-square of 20 still lead to their example, and no example is dropped."""
    rows = [(i, f"{'vile slur' if i % 2 else 'kind word'} about thing{chr(97 + i % 26)}{chr(97 + i // 26)}", "en", "s", 1) for i in range(100)]
    rows += [(200, "quagga zephyr", "en", "s", 1), (201, "zephyr quagga", "en", "s", 1)]
    labels = [(i, 1, i % 2) for i in range(100)] + [(200, 1, 0), (201, 1, 0)]
    model = toxicity.train(cases.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    learned = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5]
    assert sorted(model["index"].docs) == learned and {"quagga", "zephyr", "thing*"} <= model["vocabulary"].keys()
    got = toxicity.toxicity(cases.frame(spark, [(1, "a quagga", "", "", 1)]), model).collect()[0]
    assert got.evidence.split(":")[0] in ("200", "201") and got.predicted == 0


def test_secrets_of_letters_and_behind_paths():
    encoding = secrets.encoding_of(secrets.vocabulary(secrets.VOCABULARY))
    rng = random.Random(3)
    found = lambda t: secrets.ratio_spans(t, [], encoding)
    for letters, behind in ((string.ascii_letters, 24), (string.ascii_letters + string.digits, 24), (string.ascii_letters + string.digits + "-_", 32)):
        hits = whole = 0
        for _ in range(300):
            key = "K" + "".join(rng.choice(letters) for _ in range(behind - 2)) + "q"
            hits += found(f"a {key} b") == [(2, 3, 2 + behind)]
            prefix = "com/services/webhooks/incoming/"
            whole += any(a <= len(prefix) + 4 and b == len(prefix) + behind for a, _, b in found(prefix + key))
        assert hits >= 297 and whole >= 285, (hits, whole)
    for name in ("the_quick_brown_fox_jumps_over_2024", "com/services/webhooks/incoming/messages", "internationalization", "2024-01-15-12-30-45-000", "========================", "123e4567-e89b-42d3-a456-426614174000"):
        assert found(name) == [], name


def test_toxicity_floor_is_the_kth_best(monkeypatch):
    """No block that holds a neighbour is skipped, in whatever order a partition leaves the entries beyond the asked one."""
    partition = np.partition

    def descending(x, kth):
        y = partition(x, kth)
        y[kth % len(y) + 1 :] = np.sort(y[kth % len(y) + 1 :])[::-1]
        return y

    monkeypatch.setattr(toxicity.np, "partition", descending)
    groups = 20
    examples = [(i, 0, {i // 64: 8} | ({groups: 1 + i // 64} if i % 64 == 0 else {})) for i in range(64 * groups)]
    index = toxicity.Index(examples, np.array([1.0] * groups + [0.1]), {0: 1.0})
    near, _ = index.nearest(np.array([groups]), np.array([1.0]))
    assert {index.docs[i] // 64 for i in near} == set(range(groups - toxicity.NEIGHBOURS, groups))


SMALL = "/root/testdata/sf0.001"


def test_toxicity_query_equals_brute_force(spark, monkeypatch):
    """All cosines of all documents with all examples, worked out densely, give the query's scores."""
    kept = {}
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a: kept.setdefault("model", train(*a)))
    built = toxicity.Index.__init__

    def init(self, *a):
        built(self, *a)
        kept["rows"] = self.rows

    monkeypatch.setattr(toxicity.Index, "__init__", init)
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, SMALL).collect()}
    model, index = kept["model"], kept["model"]["index"]
    v = len(model["vocabulary"])
    examples = np.zeros((len(kept["rows"]), v))
    for k, (_, _, t, w) in enumerate(kept["rows"]):
        examples[k, t] = w
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    df = {w: 0 for w in model["vocabulary"]}
    for r in documents:
        words = set(toxicity.letter_words((r.text or "").lower()))
        for w in words | {w[:5] + "*" for w in words if len(w) > 5}:
            if w in df:
                df[w] += 1
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.toxic is not None}
    learned = [r for r in documents if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5]
    pos, neg = (sum(labels[r.doc_id] == y for r in learned) for y in (1, 0))
    idf = np.zeros(v)
    for w, i in model["vocabulary"].items():
        p, q = (sum(labels[r.doc_id] == y and (w[:-1] in {x[:5] for x in toxicity.letter_words((r.text or "").lower()) if len(x) > 5} if w.endswith("*") else w in toxicity.letter_words((r.text or "").lower())) for r in learned) for y in (1, 0)) if i < 40 else (None, None)
        if p is not None:
            chi2 = len(learned) * (p * (neg - q) - q * (pos - p)) ** 2 / max(1e-9, (p + q) * (len(learned) - p - q) * pos * neg)
            idf[i] = (np.log((1 + len(documents)) / (1 + df[w])) + 1) * (toxicity.LEAST_WEIGHT + chi2 / (chi2 + toxicity.HALF_CHI2))
            assert abs(idf[i] - index.idf[i]) < 1e-9, w
    slope, intercept = model["curve"]
    for r in documents:
        q = np.zeros(v)
        t, w = toxicity.unit(*toxicity.Terms(model["vocabulary"]).of(r.text or ""), index.idf)
        q[t] = w
        cos = np.round(np.minimum(examples @ q, 1), 12)
        near = sorted(np.flatnonzero(cos > 0), key=lambda i: (-cos[i], i))[: toxicity.NEIGHBOURS]
        p = index.vote(np.array(near, int), cos[near], model["prior"])
        want = 1 / (1 + np.exp(-(slope * np.log(p / (1 - p)) + intercept))) if near else model["prior"]
        assert abs(got[r.doc_id].score - want) < 1e-6, r.doc_id


def test_language_query_equals_brute_force(spark, monkeypatch):
    """Forward-backward written word by word, on features looked up one at a time, gives the query's answers."""
    from quern.llm import language_id, words

    kept = {}
    train = language_id.train
    monkeypatch.setattr(language_id, "train", lambda *a: kept.setdefault("model", train(*a)))
    got = {r.doc_id: r for r in language_id.op6_language_id(spark, SMALL).collect()}
    model = kept["model"]
    trans, cache = model["trans"], {}

    def emission(w):
        if w not in cache:
            at, _ = language_id.features([w], model["lexicon"], len(model["weights"]))
            s = sum(model["weights"][i].astype(np.float64) for i in at)
            cache[w] = np.exp(s - s.max())
        return cache[w]

    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        x = [emission(w) for w in words.letter_words((r.text or "").lower())]
        if not x:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        forward, backward = [x[0] / x[0].sum()], [np.ones(len(trans))]
        for e in x[1:]:
            a = (forward[-1] @ trans) * e
            forward.append(a / a.sum())
        for e in x[:0:-1]:
            b = trans @ (e * backward[-1])
            backward.append(b / b.sum())
        mean = np.mean([a * b / (a * b).sum() for a, b in zip(forward, backward[::-1], strict=True)], axis=0)
        assert abs(got[r.doc_id].score - mean.max()) < 1e-4
        assert np.sort(mean)[-1] - np.sort(mean)[-2] < 1e-3 or got[r.doc_id].lang_pred == model["langs"][int(mean.argmax())]


def test_secret_spans_equal_brute_force(spark):
    """Every ratio span of the query is random by the stated rule, and no run that is random as a whole is left out."""
    import re

    encoding = secrets.encoding_of(secrets.vocabulary(secrets.VOCABULARY))
    tokens = lambda x: len(encoding.encode_ordinary(x))
    got = {r.doc_id: r for r in secrets.op4_secrets(spark, SMALL).collect()}
    found = 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        text = r.text or ""
        spans = [x.split(":") for x in got[r.doc_id].spans.split(",") if x]
        base = [(int(a), int(b)) for k, a, b in spans if k != "ratio"]
        mine = [(int(a), int(b)) for k, a, b in spans if k == "ratio"]
        found += len(mine)
        assert len(mine) == got[r.doc_id].n_ratio
        for a, b in mine:
            assert b - a >= 20 and (b - a) / tokens(text[a:b]) < 2.0 and re.fullmatch("[A-Za-z0-9+/_=-]+", text[a:b])
            assert not any(x < b and a < y for x, y in base)
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
            s, known = m[0], re.fullmatch("(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})", m[0])
            touched = any(x < m.end() and m.start() < y for x, y in base)
            if known or touched:
                assert not any(a < m.end() and m.start() < b for a, b in mine)
            elif len(s) / tokens(s) < 2.0 and re.search("[A-Za-z]", s) and re.search("[A-Za-z][0-9]+[A-Za-z]", s) and not re.search("[_/=+-]", s):
                assert m.span() in mine, s
    assert found >= 0
