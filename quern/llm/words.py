"""Word kernels on Arrow batches: exact splitting, 64-bit word hashes, n-gram hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes handled at a time; arrays and word lists of one slice are some 20 times as large.
SLICE_BYTES = 2 << 20
#: Words remembered by a worker before its table starts afresh.
CACHE_WORDS = 400_000
LEAST_ID = -(1 << 63)

MULT = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


LETTERS = re.compile(r"[^\W\d_]+")
#: For texts within Latin-1: every character that LETTERS doesn't match becomes a space.
_SPACED = bytes(b if LETTERS.match(chr(b)) else 32 for b in range(256))


def letter_words(text: str) -> list[str]:
    """``LETTERS.findall(text)``, faster for texts within Latin-1."""
    try:
        return text.encode("latin-1").translate(_SPACED).decode("latin-1").split()
    except UnicodeEncodeError:
        return LETTERS.findall(text)


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries of h."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= MULT
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text): the id, nulls as the least long; the text as UTF-8 bytes, nulls as empty."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def public_id(col):
    """The inverse of what ``id_text`` does to ids."""
    return F.when(col != F.lit(LEAST_ID), col)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text, or one longer row."""
    size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)
