"""Secret scan: fixed patterns plus a token-efficiency test.

A byte-pair vocabulary spells ordinary words with few tokens and random strings with
many. Runs of credential characters whose characters-per-token ratio is low are reported as
kind ``ratio``, unless they are known digests or touch a span of a fixed pattern. Names of words and numbers are left
out only if the vocabulary spells them well. Of a run that is not random as a whole, the stretches between its plain words are looked at.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import id_text, public_id

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary is sent to the executors; larger files are refused.
MOST_BYTES = 64 << 20
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KINDS = ("assign", "access", "hex", "ratio")
LEAST_CHARS, MOST_RATIO = 20, 2.0

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this finds what [0-9a-f]+ of 24 or more finds
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\Z")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
#: Words, numbers and short version marks joined by _, - or /: names of files, variables, tickets.
NAME = re.compile(r"[_/=+-]*(?:[A-Za-z]+\d{0,4}|\d+)(?:[_/=+-]+(?:[A-Za-z]+\d{0,4}|\d+))*[_/=+-]*\Z")
PART = re.compile(r"[A-Za-z0-9]+")
WORD = re.compile(r"[A-Za-z]+\d{0,4}\Z")
#: Shorter words may stand in a random string by chance; they do not divide a run.
LEAST_WORD = 4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def ratio(s: str, encoding) -> float:
    """Characters per token."""
    return len(s) / len(encoding.encode_ordinary(s))


def is_plain(part: str, encoding) -> bool:
    """A number, a single token, or a word that few tokens spell."""
    return part.isdigit() or (WORD.match(part) is not None and (ratio(part, encoding) >= MOST_RATIO or ratio(part, encoding) == len(part)))


def is_random(s: str, encoding) -> bool:
    """Low token efficiency, with letters, no known digest, no identifier whose parts are mostly plain."""
    if DIGEST.match(s) or UUID.match(s) or not any(c.isalpha() for c in s) or ratio(s, encoding) >= MOST_RATIO:
        return False
    if not NAME.match(s):
        return True
    parts = PART.findall(s)
    return 2 * sum(len(x) for x in parts if not is_plain(x, encoding)) >= sum(map(len, parts))


def candidates(s: str, encoding) -> Iterator[tuple[int, int]]:
    """Stretches of parts between the plain words of a run."""
    start = end = None
    for m in PART.finditer(s):
        if m.end() - m.start() >= LEAST_WORD and WORD.match(m[0]) and is_plain(m[0], encoding):
            if start is not None:
                yield start, end
            start = None
        else:
            start, end = (m.start() if start is None else start), m.end()
    if start is not None:
        yield start, end


def ratio_spans(text: str, base: list[tuple[int, int, int]], encoding) -> list[tuple[int, int, int]]:
    """Runs that are random as a whole; of the others the stretches that are."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if any(s < b and a < e for s, _, e in base):
            continue
        if is_random(m[0], encoding):
            out.append((a, 3, b))
        elif not (DIGEST.match(m[0]) or UUID.match(m[0])):
            out += [(a + i, 3, a + j) for i, j in candidates(m[0], encoding) if j - i >= LEAST_CHARS and is_random(m[0][i:j], encoding)]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def vocabulary(path: str) -> bytes:
    size = os.path.getsize(path)
    if size > MOST_BYTES:
        raise ValueError(f"vocabulary of {size} bytes; at most {MOST_BYTES} are sent to executors")
    with open(path, "rb") as f:
        return f.read()


def encoding_of(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def scanned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(shared.value)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for t in batch.column("text"):
                text = t.as_py().decode("utf-8", "replace")
                base = base_spans(text)
                more = ratio_spans(text, base, encoding)
                kinds = [k for _, k, _ in base]
                row = (kinds.count(0), kinds.count(1), kinds.count(2), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)))
                for c, x in zip(out, row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.string())],
                names=["doc", "n_assign", "n_access", "n_hex", "n_ratio", "base_sha256", "spans"],
            )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_ratio, base_sha256, spans (kind:start:end in code points).

    Null and empty texts have no spans; ids are passed through, nulls and repeats included; texts are scanned
    whole; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    rows = id_text(docs, id_col, text_col).mapInArrow(scanned(shared), "doc long, n_assign long, n_access long, n_hex long, n_ratio long, base_sha256 string, spans string")
    return rows.select(public_id(F.col("doc")).alias("doc_id"), "n_assign", "n_access", "n_hex", "n_ratio", "base_sha256", "spans")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
