"""Vectorised text kernels that the operators of this package run inside tasks.

All of them work on one flat UTF-8 buffer with row offsets, so that the cost of
a row is a few array passes and no Python object is made per word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; one longer text makes a longer slice.
SLICE_BYTES = 4 << 20

_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary() if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else pa.large_string()
    column = column.cast(large).fill_null(b"" if large == pa.large_binary() else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8)[first:last], offsets - first


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes and at least one row each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """(first row, last row, bytes, offsets) for each slice of a batch."""
    buf, off = flat(batch.column(batch.schema.get_field_index(column)))
    for a, b in slices(off, limit):
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def forget() -> None:
    """Drops the powers; they are made again when needed."""
    _POWERS.clear()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def is_space(buf: np.ndarray) -> np.ndarray:
    return (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in the buffer) of `[^\\x20\\x09-\\x0D]+`, and the index of
    the first word of each row (one more entry than rows)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    ink = ~is_space(buf)
    before, after = np.empty_like(ink), np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    after[-1], after[:-1] = False, ink[1:]
    filled = off[:-1][off[1:] > off[:-1]]
    before[filled] = False
    after[off[1:][off[1:] > off[:-1]] - 1] = False
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, the same wherever a span stands."""
    n = len(buf)
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)), seed)


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of every `width` consecutive values; position p stands for h[p : p + width]."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1)
    total = np.empty(len(h) + 1, np.uint64)
    total[0] = 0
    np.cumsum(mix(h, seed + 77) * up[: len(h)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n], seed)


def room(first: np.ndarray, width: int) -> np.ndarray:
    """Row lengths in windows, from the index of each row's first word."""
    return np.maximum(np.diff(first) - width + 1, 0)


def expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges starts[i] .. starts[i] + counts[i]: all members, and the i of each."""
    counts = np.asarray(counts, np.int64)
    which = np.repeat(np.arange(len(counts)), counts)
    head = np.cumsum(counts) - counts
    return np.asarray(starts, np.int64)[which] + np.arange(len(which)) - head[which], which


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of 0 .. n that lies in any range."""
    d = np.bincount(np.clip(starts, 0, n), minlength=n + 1) - np.bincount(np.clip(ends, 0, n), minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges per row (document and tag): those that touch or overlap become one."""
    if not len(doc):
        return doc, start, end, tag
    order = np.lexsort((start, tag, doc))
    doc, start, end, tag = doc[order], start[order], end[order], tag[order]
    new = np.empty(len(doc), bool)
    new[0] = True
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    # running maximum of the ends inside a row, by lifting each row above the one before
    group = np.cumsum(new) - 1
    lift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new[1:] |= start[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - lift[last], tag[at]


def tags(buf: np.ndarray, off: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each of these rows a checksum of its text, which tells rows with the same id apart."""
    named, back = np.unique(rows, return_inverse=True)
    return np.fromiter((zlib.crc32(buf[off[k] : off[k + 1]]) for k in named.tolist()), np.uint32, len(named))[back]
