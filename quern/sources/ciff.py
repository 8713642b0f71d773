"""Common Index File Format: delimited protocol buffers, one header, then postings lists by term, then documents.

Messages are encoded and decoded by the executors; the file itself is one stream, so the driver only copies frames of
bytes, one batch at a time.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..index import Index
from ..storage import remove, shared_dir, stage

VERSION = 1
#: Frames are handed to Spark in batches of so many bytes.
BATCH_BYTES = 32 << 20
#: Executors hand frames to the file in pieces of some so many bytes.
BLOB_BYTES = 4 << 20
#: Shorter lists are parsed number by number.
FEW_BYTES = 100
#: From each of these numbers on a varint is one byte longer.
_STEPS = np.array([1 << 7 * i for i in range(1, 10) if 7 * i < 63], np.int64)
#: Wire types of the format's fields.
VARINT, FIXED64, BYTES = 0, 1, 2


def varint(n: int) -> bytes:
    """Base-128, least group first; negative numbers as 64-bit two's complement."""
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, next place)."""
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def message(*fields: tuple[int, object]) -> bytes:
    """A message of (tag, int | float | str | bytes); zeros and empty values are left out, as defaults are."""
    out = bytearray()
    for tag, v in fields:
        if isinstance(v, float):
            out += varint(tag << 3 | FIXED64) + struct.pack("<d", v) if v else b""
        elif isinstance(v, int):
            out += varint(tag << 3 | VARINT) + varint(v) if v else b""
        else:
            raw = v.encode() if isinstance(v, str) else v
            out += varint(tag << 3 | BYTES) + varint(len(raw)) + raw if raw or isinstance(v, bytes) else b""
    return bytes(out)


def fields_of(data: bytes) -> Iterator[tuple[int, object]]:
    """(tag, value) of a message: ints, doubles, bytes."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        kind = key & 7
        if kind == VARINT:
            v, at = read_varint(data, at)
        elif kind == FIXED64:
            v, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == BYTES:
            n, at = read_varint(data, at)
            v, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} is not part of the format")
        yield key >> 3, v


def postings_list(term: str, df: int, cf: int, gaps: list[tuple[int, int]]) -> bytes:
    return message((1, term), (2, df), (3, cf), *((4, message((1, g), (2, tf))) for g, tf in gaps))


def parse_postings(data: bytes) -> tuple[str, int, int, list[int], list[int]]:
    """(term, df, cf, docids, tfs), gaps summed up."""
    term, df, cf, docids, tfs, last = "", 0, 0, [], [], 0
    for tag, v in fields_of(data):
        if tag == 1:
            term = v.decode()
        elif tag == 2:
            df = v
        elif tag == 3:
            cf = v
        elif tag == 4:
            one = dict(fields_of(v))
            last += one.get(1, 0)
            docids.append(last)
            tfs.append(one.get(2, 0))
    return term, df, cf, docids, tfs


@contextmanager
def stream(path: str, mode: str, packed: bool = True):
    """A binary stream of any store that Arrow reads; names in .gz are compressed if ``packed``."""
    fs, where = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    with (fs.open_input_stream if mode == "rb" else fs.open_output_stream)(where, compression=None) as raw:
        if packed and where.endswith(".gz"):
            with gzip.GzipFile(fileobj=raw, mode=mode) as f:
                yield f
        else:
            yield raw


def header(index: Index, description: str = "") -> DataFrame:
    """One row: the header's fields."""
    n = index.dict.agg(F.count("*").alias("n"))
    total = index.docs.agg(F.count("*").alias("num_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_terms"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("average_doclength"))
    return n.join(total).select(
        F.lit(VERSION).alias("version"), F.col("n").alias("num_postings_lists"), "num_docs", F.col("n").alias("total_postings_lists"),
        F.col("num_docs").alias("total_docs"), F.col("total_terms").alias("total_terms_in_collection"), "average_doclength", F.lit(description).alias("description"),
    )


def _by_document(index: Index) -> DataFrame:
    p = index.postings
    return p.groupBy("termid", "docid").agg(F.sum("tf").alias("tf")) if index.has_many_fields else p.select("termid", "docid", "tf")


def gaps(index: Index) -> DataFrame:
    """(term, docid, gap, tf): each posting with the distance to the one before it in its list, from 0."""
    before = F.lag("docid", 1, 0).over(W.partitionBy("termid").orderBy("docid"))
    rows = _by_document(index).withColumn("gap", F.col("docid") - before)
    return rows.join(index.dict.select("termid", "term"), "termid").select("term", "docid", "gap", "tf")


def encoded_pairs(gaps: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the postings (gap, tf), numbers of at least 0, and where each begins, with the end."""
    sizes = [np.searchsorted(_STEPS, v, "right") + 1 for v in (gaps, tfs)]
    inner = sum(np.where(v > 0, n + 1, 0) for v, n in zip((gaps, tfs), sizes, strict=True))
    starts = np.concatenate([[0], np.cumsum(inner + 2)])
    out = np.empty(starts[-1], np.uint8)
    at = starts[:-1]
    out[at], out[at + 1] = 4 << 3 | BYTES, inner
    at = at + 2
    for tag, v, n in ((1, gaps, sizes[0]), (2, tfs, sizes[1])):
        there = v > 0
        p, left, size = at[there], v[there], n[there]
        out[p] = tag << 3 | VARINT
        for k in range(int(size.max(initial=0))):
            more = size > k
            out[p[more] + 1 + k] = left[more] & 0x7F | np.where(size[more] > k + 1, 0x80, 0)
            left = left >> 7
        at = at + np.where(there, n + 1, 0)
    return out, starts


def _blobs(frames: Iterator[bytes], packed: bool) -> Iterator[pa.RecordBatch]:
    """Frames with their lengths, many in one value, each a gzip member if ``packed``."""
    held, size = [], 0

    def put() -> pa.RecordBatch:
        data = b"".join(held)
        return pa.RecordBatch.from_arrays([pa.array([gzip.compress(data, 6) if packed else data], pa.binary())], names=["frames"])

    for frame in frames:
        held += [varint(len(frame)), frame]
        size += len(frame)
        if size > BLOB_BYTES:
            yield put()
            held, size = [], 0
    if held:
        yield put()


def _encoded_postings(packed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            ends, rows = batch.column("postings").offsets.to_numpy(), batch.column("postings").flatten()
            ends = ends - ends[0]
            docids, tfs = rows.field(0).to_numpy(), rows.field(1).to_numpy()
            gaps = np.diff(docids, prepend=0)
            first = ends[:-1][np.diff(ends) > 0]
            gaps[first] = docids[first]
            data, starts = encoded_pairs(gaps, tfs)
            whole = memoryview(data)
            heads = zip(*(batch.column(c).to_pylist() for c in ("term", "df", "cf")), strict=True)
            for i, (term, df, cf) in enumerate(heads):
                yield message((1, term), (2, df), (3, cf)) + bytes(whole[starts[ends[i]] : starts[ends[i + 1]]])

    return lambda batches: _blobs(frames(batches), packed)


def _encoded_docs(packed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for r in batch.to_pylist():
                yield message((1, r["docid"]), (2, r["name"]), (3, r["len"]))

    return lambda batches: _blobs(frames(batches), packed)


def export_ciff(index: Index, path: str, description: str = "") -> None:
    """Writes the index as one file: postings lists by term, documents by name.

    The format holds a term's list in one message, so the longest list has to fit into a task.
    """
    lists = _by_document(index).groupBy("termid").agg(F.sort_array(F.collect_list(F.struct("docid", "tf"))).alias("postings"), F.sum("tf").alias("cf"))
    lists = lists.join(index.dict, "termid").select("term", "df", "cf", "postings")
    packed = path.endswith(".gz")
    parts = [
        stage(lists, "ciff-lists").orderBy("term").mapInArrow(_encoded_postings(packed), "frames binary"),
        index.docs.select("docid", "name", "len").orderBy("name").mapInArrow(_encoded_docs(packed), "frames binary"),
    ]
    # staged, as all tasks write at once what the driver then copies part by part
    parts = [stage(x.withColumn("at", F.monotonically_increasing_id()), "ciff-encoded") for x in parts]
    h = header(index, description).first()
    with stream(path, "wb", packed=False) as f:
        first = message(*((i, v) for i, v in enumerate(h, 1)))
        first = varint(len(first)) + first
        f.write(gzip.compress(first) if packed else first)  # members one after the other are one file
        for frames in parts:
            for row in frames.orderBy("at").select("frames").toLocalIterator():
                f.write(bytes(row.frames))


def _frames(f) -> Iterator[bytes]:
    while first := f.read(1):
        n, shift = first[0] & 0x7F, 7
        b = first[0]
        while b > 0x7F:
            b = f.read(1)[0]
            n |= (b & 0x7F) << shift
            shift += 7
        data = f.read(n)
        if len(data) < n:
            raise ValueError("the file ends within a message")
        yield data


def decoded(data: bytes) -> tuple[str, int, int, np.ndarray, np.ndarray]:
    """``parse_postings``; long lists, if each posting has its two fields in their order, as a whole."""
    head = data.find(bytes([4 << 3 | BYTES]), _head_end(data)) if len(data) > FEW_BYTES else -1
    if head >= 0:
        b = np.frombuffer(data, np.uint8, offset=head)
        ends = np.flatnonzero(b < 0x80)  # keys, lengths and numbers alike
        starts = np.concatenate([[0], ends[:-1] + 1])
        size = ends - starts + 1
        if len(ends) % 6 == 0 and ends[-1] == len(b) - 1 and size.max() <= 9:
            numbers = np.zeros(len(ends), np.int64)
            for k in range(int(size.max())):
                more = size > k
                numbers[more] |= (b[starts[more] + k] & 0x7F).astype(np.int64) << (7 * k)
            n, size = numbers.reshape(-1, 6), size.reshape(-1, 6)
            if (n[:, (0, 2, 4)] == (4 << 3 | BYTES, 1 << 3, 2 << 3)).all() and (n[:, 1] == size[:, 2:].sum(axis=1)).all():
                term, df, cf, _, _ = parse_postings(data[:head])
                return term, df, cf, np.cumsum(n[:, 3]), n[:, 5]
    term, df, cf, docids, tfs = parse_postings(data)
    return term, df, cf, np.array(docids, np.int64), np.array(tfs, np.int64)


def _head_end(data: bytes) -> int:
    """Where the fields before the first posting end."""
    at = 0
    while at < len(data):
        key, after = read_varint(data, at)
        if key == (4 << 3 | BYTES):
            break
        n, after = read_varint(data, after)
        at = after + n if key & 7 == BYTES else after
    return at


def _decoded_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [decoded(x) for x in batch.column("frame").to_pylist()]
        none = [np.zeros(0, np.int64)]
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(none + [r[i] for r in rows])) for i in (3, 4)], names=["docid", "tf"])
        ends = pa.array(np.cumsum([0] + [len(r[3]) for r in rows]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("nr"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.ListArray.from_arrays(ends, pairs)],
            names=["termid", "term", "df", "postings"],
        )


def _decoded_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [dict(fields_of(x)) for x in batch.column("frame").to_pylist()]
        cols = [pa.array([r.get(1, 0) for r in rows], pa.int64()), pa.array([r.get(2, b"").decode() for r in rows], pa.string()), pa.array([r.get(3, 0) for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["docid", "name", "len"])


def import_ciff(spark: SparkSession, path: str, tokenizer: str = "regex", stemmer: str = "none") -> Index:
    """The index in a file; term ids are the places of the lists in it. ``tokenizer`` ("regex" or "longest") is used for queries."""
    if tokenizer not in ("regex", "longest"):
        raise ValueError(f"unknown tokenizer {tokenizer!r}")
    raw = shared_dir(spark, "ciff-frames")
    empty = spark.createDataFrame([], "kind int, nr long, frame binary")
    empty.write.parquet(raw)
    with stream(path, "rb") as f:
        frames = _frames(f)
        head = dict(fields_of(next(frames)))
        n_lists = head.get(2, 0)
        rows: list[tuple[int, int, bytes]] = []
        held = 0

        def put() -> None:
            t = pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "nr": pa.array([r[1] for r in rows], pa.int64()), "frame": pa.array([r[2] for r in rows], pa.binary())})
            spark.createDataFrame(t).write.mode("append").parquet(raw)

        for i, data in enumerate(frames):
            rows.append((0, i, data) if i < n_lists else (1, i - n_lists, data))
            held += len(data)
            if held > BATCH_BYTES:
                put()
                rows, held = [], 0
        if rows:
            put()
    all_frames = spark.read.schema(empty.schema).parquet(raw)
    lists = stage(all_frames.where("kind = 0").select("nr", "frame").mapInArrow(_decoded_postings, "termid long, term string, df long, postings array<struct<docid: long, tf: long>>"), "ciff-decoded")
    docs = stage(all_frames.where("kind = 1").select("frame").mapInArrow(_decoded_docs, "docid long, name string, len long"), "ciff-docs")
    remove(spark, raw)
    terms = lists.select("termid", "term", "df")
    postings = lists.select("termid", F.inline("postings")).select("termid", "docid", F.lit(0).cast("long").alias("fieldid"), "tf")
    stats = terms.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("sumdf")).select(
        F.lit(head.get(3, 0)).cast("long").alias("num_docs"), F.lit(float(head.get(7, 0.0))).alias("avgdl"), "sumdf",
        F.lit("standard").alias("index_type"), F.lit(stemmer).alias("stemmer"), F.lit(tokenizer).alias("tokenizer"),
    )
    return Index(docs, terms, postings, spark.createDataFrame([], "fieldid long, field string"), spark.createDataFrame([], "sw string"), stats)
