"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The machine is compiled from a model file. Its arcs read the raw text: the normaliser (space to U+2581) is composed with the
pieces when they are compiled, so wherever a piece has U+2581 there is an arc for either; a start arc writes the leading
U+2581; a character that no piece has is read by a byte arc, which writes its bytes. Weights lie in the tropical semiring.
In a unigram model the weight of an arc is the piece's negative score, and the path of least weight comes from a pass over the
positions. In a merge-trained (BPE) model it depends on the piece before: nothing if that pair of pieces is stable under the model's own merge order,
infinity if a merge would cross their border. A sequence of pieces is what merging yields exactly when all neighbouring pairs are
stable, so the path of least weight is the library's own result; as finite weights are all equal, the first path that reaches the
end is one, and arcs are weighed only when their turn comes. A state is the position and the piece before it.

No piece has U+2581 after another character, and in many models none has a
letter before a character that is none. There the composed machine has one state only, through which every path leads: the
least path is the sequence of the least paths between such states, and those of a merge-trained model are remembered by the worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import id_text, public_id, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_BYTES = 64 << 20
BAR = "▁"
#: Bytes of paths, and stable or crossing pairs, that a worker remembers before it starts afresh.
CACHE_BYTES, CACHE_PAIRS = 128 << 20, 1_000_000
INFINITE = float("inf")
#: What the library takes off the least score for a character without a piece.
UNKNOWN_PENALTY = 10.0
LETTER = re.compile(r"[^\W\d_]")
#: Inputs fall apart before U+2581, and where no piece has a letter before another character also there.
COARSE = re.compile(f"[{BAR} ]*[^{BAR} ]+|[{BAR} ]+")
FINE = re.compile(rf"[{BAR} ]*[^\W\d_]+|[{BAR} ]*(?:(?![^\W\d_])[^{BAR} ])+[^\W\d_]*|[{BAR} ]+")
NORMAL, BYTE, UNIGRAM, MERGES = 1, 6, 1, 2
#: In place of a piece: the start, and a character read by a byte arc.
START, BYTES = -1, -2


def model_of(data: bytes) -> tuple[list[tuple[str, float, int]], bool, int]:
    """(piece, score, type) by id, whether a leading space is added, and the model's type; other normalisers and types are refused."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(data)
    spec, kind = m.normalizer_spec, m.trainer_spec.model_type
    if kind not in (UNIGRAM, MERGES) or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not m.trainer_spec.byte_fallback:
        raise ValueError("only unigram and merge-trained models with byte fallback and the identity normaliser are supported")
    return [(p.piece, p.score, p.type) for p in m.pieces], spec.add_dummy_prefix, kind


class Transducer(dict):
    """As a dict: the output labels (ids) of a part of the text between two states that every path leads through, remembered."""

    def __init__(self, data: bytes) -> None:
        pieces, prefix, self.kind = model_of(data)
        self.prefix = BAR if prefix else ""
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.scores = [s for _, s, _ in pieces]
        self.bytes = [0] * 256
        self.outputs: list[str] = []
        self.byte_of: dict[int, int] = {}
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            self.outputs.append(p if kind == NORMAL else "" if kind == 3 else " ⁇ ")
        self.pairs: dict[int, float] = {}
        self.held = 0
        self.unknown = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        linked = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.parts = COARSE if any(LETTER.match(a) and not LETTER.match(b) for a, b in linked) else FINE
        letters = {c for p in self.ids for c in p}
        if any(BAR in p.lstrip(BAR) for p in self.ids) or (self.kind == MERGES and any(c not in self.ids for c in letters)):
            raise ValueError("pieces that span words or lack their letters are not supported")
        self.trie: dict = {}
        for p, i in self.ids.items():
            if self.kind == UNIGRAM or len(p) == 1 or self.merged(p) == [p]:
                node = self.trie
                for c in p:
                    if c not in node:
                        node[c] = {}
                        if c == BAR:
                            node[" "] = node[c]  # the normaliser's arc
                    node = node[c]
                node[""] = i

    def merged(self, text: str) -> list[str]:
        """What the model's merges make of a short text: best score first, leftmost of equals."""
        parts, ids, scores = list(text), self.ids, self.scores
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best[0]):
                    best = (scores[i], k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def weight(self, before: int, k: int) -> float:
        """Of the arc for piece k after another one, in a merge-trained model. No merge crosses the border of a byte arc."""
        if before < 0 or k < 0:
            return 0.0
        w = self.pairs.get(before << 20 | k)
        if w is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            a, b = self.outputs[before], self.outputs[k]
            self.pairs[before << 20 | k] = w = 0.0 if self.merged(a + b) == [a, b] else INFINITE
        return w

    def arcs(self, text: str, i: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs that read ``text`` from position i, shorter ones first; without any the byte arc."""
        node, out = self.trie, []
        for j in range(i, len(text)):
            node = node.get(text[j])
            if node is None:
                break
            k = node.get("")
            if k is not None:
                out.append((j + 1, k))
        return out or [(i + 1, BYTES)]

    def stable_path(self, text: str) -> tuple[list[int], list[int]]:
        """(ends, pieces) along a path of finite weight. Of a state's arcs the longest is weighed first; a state that leads nowhere is left for good.

        What is held is one frame a piece: its end, the piece and how many arcs behind it were weighed.
        """
        n, trie, known = len(text), self.trie, self.pairs
        ends, path, turns, dead = [0], [START], [0], set()
        i, before, turn = 0, START, 0
        while i < n:
            node, arcs = trie, []
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                k = node.get("")
                if k is not None:
                    arcs.append((j + 1, k))
            if not arcs:
                arcs.append((i + 1, BYTES))
            arcs.reverse()
            for j, k in arcs[turn:] if turn else arcs:
                turn += 1
                if dead and (j << 20 | k) in dead:
                    continue
                if before >= 0 and k >= 0:
                    w = known.get(before << 20 | k)
                    if self.weight(before, k) if w is None else w:
                        continue
                turns[-1] = turn
                ends.append(j)
                path.append(k)
                turns.append(0)
                i, before, turn = j, k, 0
                break
            else:
                dead.add(i << 20 | before)
                ends.pop()
                path.pop()
                turns.pop()
                i, before, turn = ends[-1], path[-1], turns[-1]
        return ends[1:], path[1:]

    def lightest_path(self, text: str) -> tuple[list[int], list[int]]:
        """(ends, pieces) along the path of least weight of a unigram model: positions are relaxed from left to right."""
        n = len(text)
        weight, via = np.full(n + 1, np.inf, np.float32), [(0, START)] * (n + 1)
        weight[0] = 0
        for i in range(n):
            arcs = self.arcs(text, i)
            if arcs[0][0] != i + 1:
                arcs.append((i + 1, BYTES))  # the library offers it wherever no single character is a piece
            for j, k in arcs:
                w = weight[i] - np.float32(self.unknown if k == BYTES else self.scores[k])
                if w < weight[j]:
                    weight[j], via[j] = w, (i, k)
        ends, path = [], []
        while n:
            ends.append(n)
            n, k = via[n]
            path.append(k)
        return ends[::-1], path[::-1]

    def labels(self, text: str) -> tuple[int, ...]:
        """The ids along the least path over ``text``."""
        ends, path = self.lightest_path(text) if self.kind == UNIGRAM else self.stable_path(text)
        if BYTES not in path:
            return tuple(path)
        out, start = [], 0
        for end, k in zip(ends, path, strict=True):
            out += [k] if k >= 0 else [self.bytes[b] for b in text[start:end].encode("utf-8", "surrogatepass")]
            start = end
        return tuple(out)

    def __missing__(self, part: str) -> tuple[int, ...]:
        path = self.labels(part)
        size = 200 + 4 * len(part) + 8 * len(path)
        if size < CACHE_BYTES >> 4:
            if self.held + size > CACHE_BYTES:
                self.clear()
                self.held = 0
            self.held += size
            self[part] = path
        return path

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.kind == UNIGRAM:  # the library's single-precision sums, which settle ties, run over the whole text
            return list(self.labels(self.prefix + text))
        return list(chain.from_iterable(map(self.__getitem__, self.parts.findall(self.prefix + text))))

    def decode(self, ids: list[int]) -> str:
        outputs, byte_of = self.outputs, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            text = "".join(map(outputs.__getitem__, ids))
        else:
            raw = b"".join([bytes((byte_of[i],)) if i in byte_of else outputs[i].encode("utf-8", "surrogatepass") for i in ids])
            text = raw.decode("utf-8", "replace")
        text = text.replace(BAR, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def model_bytes(path: str) -> bytes:
    size = os.path.getsize(path)
    if size > MOST_BYTES:
        raise ValueError(f"model of {size} bytes; at most {MOST_BYTES} are sent to executors")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def machine_of(data: bytes) -> Transducer:
    """The machine of a model, kept by the worker from task to task with what it remembers."""
    return Transducer(data)


def lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))))


def encoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(shared.value)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                texts = [t.decode("utf-8", "replace") for t in part.column("text").to_pylist()]
                rows = [machine.encode(t) for t in texts]
                back = [machine.decode(r) for r in rows]
                same = [b == (t if BAR not in t else t.replace(BAR, " ")) for b, t in zip(back, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array([len(r) for r in rows], pa.int32()), pa.array(same), lists(rows)],
                    names=["doc", "n_tokens", "round_trip", "ids"],
                )

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """One row per input row: doc_id, n_tokens, round_trip (decoding gives the text back, U+2581 read as a space), ids.

    Null and empty texts have no tokens; ids are passed through, nulls and repeats included; texts, very long ones too, are
    encoded whole, in memory of some hundred bytes a character of the longest stretch without a blank; of paths of equal weight the one
    that the library takes. An empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    rows = id_text(docs, id_col, text_col).mapInArrow(encoded(shared), "doc long, n_tokens int, round_trip boolean, ids array<int>")
    return rows.select(public_id(F.col("doc")).alias("doc_id"), "n_tokens", "round_trip", "ids")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """One row per input row: doc_id, text; null or empty id lists give empty texts."""
    shared = tokens.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(shared.value)
        for batch in batches:
            texts = [machine.decode([i for i in x or [] if i is not None]) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
