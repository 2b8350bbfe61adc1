"""Columns of integers and bytes, packed into one compressed binary value.

A shuffle of tens of millions of small rows costs more in row headers than in
content. Operators here sort the rows of a slice by bucket inside the task, pack
each bucket's rows into one block and let Spark shuffle (bucket, block) rows.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import cut, qualified, shared_dir
from . import textkit as tk

__all__ = ["cut", "qualified", "shared_dir"]

BLOCK_SCHEMA = "bucket long, block binary"
_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.binary())])


def _planes(a: np.ndarray) -> bytes:
    """Byte planes, so that the constant high bytes of integers compress away."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.itemsize > 1 and len(a) else a.tobytes()


def pack(*arrays: np.ndarray, delta: tuple[int, ...] = ()) -> bytes:
    """Arrays as one value. Those whose index is in delta must be ascending."""
    parts = [struct.pack("<B", len(arrays))]
    body = []
    for k, a in enumerate(arrays):
        code = {"u": 0, "i": 1, "f": 2}[a.dtype.kind]
        parts.append(struct.pack("<BBBq", code, a.itemsize, k in delta, len(a)))
        if k in delta and len(a):
            a = np.diff(a, prepend=a.dtype.type(0))
        body.append(_planes(a))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts + body))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    count, at, heads, out = raw[0], 1, [], []
    for _ in range(count):
        heads.append(struct.unpack_from("<BBBq", raw, at))
        at += 11
    for code, size, isdelta, n in heads:
        kind = np.dtype(f"{'uif'[code]}{size}")
        a = np.frombuffer(raw, np.uint8, n * size, at)
        at += n * size
        if size > 1 and n:
            a = np.ascontiguousarray(a.reshape(size, n).T).reshape(-1)
        a = a.view(kind)
        out.append(np.cumsum(a, dtype=kind) if isdelta and n else a)
    return out


def joined(blocks: list[bytes]) -> list[np.ndarray]:
    """The arrays of several blocks, one after the other."""
    got = [unpack(b) for b in blocks]
    return [np.concatenate(x) for x in zip(*got, strict=True)]


def give_back() -> None:
    """Returns freed memory to the system: workers stay alive between stages, and what they hold counts for their executor."""
    tk.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidy(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable:
    """A function of cogrouped tables that gives memory back after each group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        give_back()
        return out

    return run


def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=_ARROW)


def batches(rows: Iterator[tuple[int, bytes]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of a few MB."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[1])
        if size >= limit:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)
    give_back()


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray, delta: tuple[int, ...] = ()) -> Iterator[tuple[int, bytes]]:
    """One packed block for each bucket; `bucket` must be ascending."""
    if not len(bucket):
        return
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.append(0, cut), np.append(cut, len(bucket)), strict=True):
        yield int(bucket[a]), pack(*(x[a:b] for x in arrays), delta=delta)


def high_bits(h: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of a hash: its highest bits, so that sorting by hash sorts by bucket."""
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def bits_for(total: float, each: float) -> int:
    """log2 of the number of buckets for about `each` units a bucket. It grows with the input without end."""
    return max(3, int(np.ceil(np.log2(max(1.0, total / each)))))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one pass that reads one column and returns one number."""
    return int(docs.agg(F.sum(F.octet_length(column).cast("long")).alias("n")).first()["n"] or 0)


#: Bytes of text for each shuffle partition, where that makes more of them than the session asks for.
PARTITION_BYTES = 96 << 20


def spread(df: DataFrame, total: int) -> DataFrame:
    """Rows by bucket, in partitions that follow the bytes of text; as the session has it, if that is enough."""
    want = -(-total // PARTITION_BYTES)
    return df.repartition(want, "bucket") if want > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def regrouped(df: DataFrame, total: int = 0) -> DataFrame:
    """Blocks of a bucket side by side in one task."""
    wide = spread(df, total)
    return (df.repartition("bucket") if wide is df else wide).sortWithinPartitions("bucket")


def each_bucket(work: Callable[[int, list[bytes]], Iterator]) -> Callable:
    """A mapInArrow function that hands over one bucket at a time; it holds no more than that."""

    def run(stream):
        now, held = None, []
        for rb in stream:
            blocks = rb.column(1)
            for k, b in enumerate(rb.column(0).to_pylist()):
                if b != now:
                    if held:
                        yield from work(now, held)
                    now, held = b, []
                held.append(blocks[k].as_py())
        if held:
            yield from work(now, held)
        held = []
        give_back()

    return run


def doc_bucket(doc: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of a document id; doc_bucket_sql gives the same in SQL."""
    return (doc ^ (doc >> 11) ^ (doc >> 23)) & ((1 << bits) - 1)


def doc_bucket_sql(column: str, bits: int) -> Column:
    d = F.coalesce(F.col(column).cast("long"), F.lit(-1).cast("long"))
    return d.bitwiseXOR(F.shiftright(d, 11)).bitwiseXOR(F.shiftright(d, 23)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def texts(docs: DataFrame, bits: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, doc_id, text): what cogroups with blocks by document. Spark plans its exchange once."""
    return docs.select(doc_bucket_sql(id_column, bits).alias("bucket"), F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def to_documents(doc: np.ndarray, bits: int, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blocks of (doc, *arrays), one for each document bucket."""
    b = doc_bucket(doc, bits)
    order = np.lexsort((doc, b))
    yield from by_bucket(b[order], doc[order], *(x[order] for x in arrays), delta=(0,))
