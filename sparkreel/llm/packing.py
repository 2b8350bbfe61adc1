"""Order-preserving packing of documents into training sequences.

A task reads its documents in order as one stream of token ids (each document's ids
and then END). Sequences are windows of that stream of at most LENGTH ids. Where to
cut is a dynamic program over the boundaries of the stream:

    f(j) = penalty(j) + min over boundaries i with b(j) - b(i) <= LENGTH of f(i) + padding(b(j) - b(i))

padding is what is missing to LENGTH, or 0 if the window's length is a power of two.
A boundary is the end of a document (penalty 0), of a sentence (SENTENCE) or, inside
a sentence of more than LONG ids, every LONG ids (INSIDE). f(i) + b(i) does not
depend on j, so the best i of a sliding window comes from a monotone queue; the
windows whose length is a power of two are looked up besides.

Scale. No shuffle: packing needs an order, and each scan partition is a stream of its
own. The program runs on about CHUNK ids at a time and carries its last, unfinished
sequence on, so memory is bounded by the chunk and the longest document; only the last
sequence of a partition can be short. Sequence ids are partition << 33 plus a counter;
a retried task gives the same rows.

Tokens. Ids come from a public tokenizer file whose path is a parameter. White space
separates its pre-tokens, so each different word is encoded once per task and looked
up afterwards; strings of special tokens are ordinary text.

Defined cases: null or empty text is a document of the one id END. Repeated rows are
documents of their own. A null doc_id comes back as null. Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import blocks as bl
from . import textkit as tk

LENGTH, END = 4096, 2
SENTENCE, INSIDE, LONG = 4, 64, 256
CHUNK = 1 << 19
WORDS_HELD = 500_000
_BAR = "|"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1: an ASCII letter; 2: a mark that no letter run holds.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[list(b",.;:!?")] = 2

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Words(dict):
    """Numbers of words, given out as they are first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Ids of texts by way of their different words.

    The tokenizer folds case and treats a run of letters and the marks after it as separate
    pre-tokens, so words are looked up without case (of ASCII) and cut before such marks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bar = self.tokenizer.encode(_BAR, add_special_tokens=False).ids
        self.reset()

    def reset(self) -> None:
        self.words, self.ids, self.ends, self.stops = Words(), np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)
        self.count = 0

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many of each). Many words go through the tokenizer as one text, with bars between them."""
        groups = [words[k : k + 128] for k in range(0, len(words), 128)]
        ids, sizes = [], []
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([f" {_BAR} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            a = np.array(got.ids, np.uint32)
            bars = np.flatnonzero(a == self.bar[0])
            if len(bars) == len(group) - 1:
                ids.append(np.delete(a, bars))
                sizes.append(np.diff(np.concatenate([[-1], bars, [len(a)]])) - 1)
            else:  # a word has the bar's id itself
                alone = [e.ids for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                ids.append(np.fromiter(chain.from_iterable(alone), np.uint32))
                sizes.append(np.fromiter(map(len, alone), np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self) -> None:
        total = len(self.words)
        if total == self.count:
            return
        new = list(islice(self.words, self.count, None))
        got, n = self._ids([w.decode("utf-8", "replace") for w in new])
        have = int(self.ends[self.count])
        ends = have + np.cumsum(n)
        for name, need in (("ids", int(ends[-1])), ("ends", total + 1), ("stops", total)):
            a = getattr(self, name)
            if len(a) < need:
                setattr(self, name, np.concatenate([a, np.zeros(max(need, len(a)), a.dtype)]))
        self.ids[have : ends[-1]] = got
        self.ends[self.count + 1 : total + 1] = ends
        self.stops[self.count : total] = np.fromiter((w[-1] in b".!?" for w in new), bool, len(new))
        self.count = total

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all rows: ids with END after each, the rows' ends in them, ends of sentences in them."""
        if len(self.words) > WORDS_HELD:
            self.reset()
        kind = _KIND[buf]
        at = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
        at = at[~np.isin(at, off)] if len(at) else at
        raw = np.insert(_LOWER[buf], at, 32).tobytes()
        off = (off + np.searchsorted(at, off)).tolist()
        split = [raw[i:j].split() for i, j in zip(off[:-1], off[1:], strict=True)]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        code = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self.learn()
        size = self.ends[code + 1] - self.ends[code]
        at, which = tk.expand(self.ends[code], size)
        last = np.cumsum(size)  # of each word
        doc_of = np.repeat(np.arange(len(split)), counts)
        doc_end = np.append(0, last)[np.cumsum(counts)] + np.arange(1, len(split) + 1)
        out = np.full(len(at) + len(split), END, np.uint32)
        out[np.arange(len(at)) + doc_of[which]] = self.ids[at]
        return out, doc_end, (last + doc_of)[self.stops[code]]


_HELD: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; its words serve all tasks of the process."""
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]


def cuts(bounds: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of ascending boundaries (the first is the start), those at which the cheapest windows are cut, the last included.

    No two neighbouring boundaries may be more than `length` apart.
    """
    b, pen = bounds.tolist(), penalty.tolist()
    exact: dict[int, list[int]] = {}
    size = 1
    while size <= length:
        at = np.searchsorted(bounds, bounds - size)
        hit = np.flatnonzero((bounds - size >= bounds[0]) & (bounds[at] == bounds - size))
        for j, i in zip(hit.tolist(), at[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
        size *= 2
    f, back = [0] * len(b), [0] * len(b)
    queue = deque([(b[0], 0)])  # (f(i) + b(i), i), values ascending
    for j in range(1, len(b)):
        x = b[j]
        while b[queue[0][1]] < x - length:
            queue.popleft()
        least, i = queue[0]
        least += length - x
        for k in exact.get(j, ()):
            if f[k] < least:
                least, i = f[k], k
        f[j], back[j] = v, _ = least + pen[j], i
        v += x
        while queue and queue[-1][0] >= v:
            queue.pop()
        queue.append((v, j))
    out, j = [], len(b) - 1
    while j:
        out.append(j)
        j = back[j]
    return np.array(out[::-1], np.int64)


def boundaries(n: int, doc_ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All boundaries of a stream of n ids from 0 on, and their penalties."""
    pen = np.full(n + 1, -1, np.int64)
    pen[stops] = SENTENCE
    pen[doc_ends] = 0
    pen[0] = pen[n] = 0
    have = np.flatnonzero(pen >= 0)
    gap = np.diff(have)
    wide = np.flatnonzero(gap > LONG)
    if len(wide):
        at, which = tk.expand(np.zeros(len(wide), np.int64), (gap[wide] - 1) // LONG)
        inner = have[wide][which] + (at + 1) * LONG
        pen[inner] = INSIDE
        have = np.flatnonzero(pen >= 0)
    return have, pen[have]


class _Stream:
    """Ids and documents that are not yet in a finished sequence."""

    def __init__(self, base: int):
        self.next, self.ids, self.docs, self.stops = base, np.zeros(0, np.uint32), [], np.zeros(0, np.int64)

    def add(self, ids, doc_ends, stops, names):
        shift, starts = len(self.ids), np.append(0, doc_ends[:-1])
        self.docs += [(name, int(a) + shift, int(b) + shift, 0, int(b - a)) for name, a, b in zip(names, starts, doc_ends, strict=True)]
        self.ids = np.concatenate([self.ids, ids])
        self.stops = np.concatenate([self.stops, stops + shift])

    def finish(self, last: bool) -> list[tuple]:
        """Pieces of all finished sequences; the last sequence stays unless no more ids come."""
        n = len(self.ids)
        if not n:
            return []
        b, pen = boundaries(n, np.array([d[2] for d in self.docs], np.int64), self.stops[self.stops < n])
        ends = b[cuts(b, pen)]
        if not last:
            ends = ends[:-1]
            if not len(ends):
                return []
        out, raw, k = [], self.ids.astype("<u4"), 0
        start = 0
        for end in ends.tolist():
            at = start
            while at < end:
                name, a, z, skipped, total = self.docs[k]
                to = min(z, end)
                out.append((name, skipped + at - a, to - at, zlib.crc32(raw[at:to].tobytes()), total, self.next, at - start))
                at = to
                if to == z:
                    k += 1
            self.next += 1
            start = end
        rest = self.docs[k:]
        self.docs = [(name, max(a, start) - start, z - start, skipped + max(a, start) - a, total) for name, a, z, skipped, total in rest]
        self.ids, self.stops = self.ids[start:], self.stops[self.stops > start] - start
        return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack(path):
    def run(stream):
        bl.give_back()  # what former stages left in this worker
        words, held = encoder(path), _Stream(TaskContext.get().partitionId() << 33)
        for rb in stream:
            ids = rb.column(0)
            for a, b, buf, off in tk.text_slices(rb, "text", 1 << 20):
                held.add(*words.encode(buf, off), ids.slice(a, b - a).to_pylist())
                if len(held.ids) >= CHUNK:
                    yield _batch(held.finish(False))
                    bl.give_back()
        yield _batch(held.finish(True))
        del held
        bl.give_back()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_pack(tokenizer), OUT)
