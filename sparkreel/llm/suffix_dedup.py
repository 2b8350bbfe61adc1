"""Suffix-array dedup of document bytes.

A window is WINDOW consecutive UTF-8 bytes of one document. A byte is removed when
some window over it also starts in a document with a smaller doc_id; all windows
are judged on the input and overlaps count.

Method. A suffix array over everything would have to live in one place, so windows
are dealt to shards first: a window belongs to the shard of its smallest hashed
GRAM-byte string, which is a function of its content alone, so equal windows meet
in one shard wherever they come from. Neighbouring windows mostly have the same
smallest string and form one segment. 1. The strings meet by hash; a segment whose
string is in one document only cannot share a window and ends here. 2. The bytes of
the others go to their shards. There a suffix array is built by induced sorting
(suffix_array.py), its permuted common prefixes mark runs of suffixes that agree in
WINDOW bytes, and the smallest doc_id of a run decides about each window in it.
3. Each document drops the bytes of its covered windows.

Scale. Shuffles carry packed blocks: string hashes, the bytes of shared segments,
ranges per document, and the texts once (both uses share one exchange). The number of
shards follows the bytes. A segment that one group of documents (some MB of text)
holds in more than HOT documents is sent with its smallest doc_id only, which covers
the others; so a passage in a third of all documents costs HOT rows a group, never
one a copy, and a string's hash costs one row for each slice of text.

Defined cases: null or empty text has 0 bytes and nothing removed; the hash is that
of the empty string. Rows with a null doc_id are compared with nothing and keep
every byte. Rows that share a doc_id never remove anything from each other; each loses
what documents with smaller ids cover of its own text, as blocks name a row by its id
and a checksum of its text. Repeated rows come out alike. An empty table gives no rows.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as bl
from . import suffix_array as sx
from . import textkit as tk

WINDOW, GRAM, HOT = 50, 20, 8
_CHUNK = 1 << 17
_MARK = np.uint32(0xFFFFFFFF)
_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _smallest(buf: np.ndarray) -> np.ndarray:
    """For each window start, the smallest hash of the strings of GRAM bytes inside."""
    n = len(buf) - WINDOW + 1
    out = np.empty(max(n, 0), np.uint64)
    for a in range(0, n, _CHUNK):  # arrays of a chunk stay in the cache
        part = buf[a : a + _CHUNK + WINDOW - 1]
        w = sx.word_view(sx.padded(part))
        m = len(part) - GRAM + 1
        h = w[:m] * _C[0] + (w[8 : m + 8] ^ (w[:m] >> np.uint64(29))) * _C[1] + (w[12 : m + 12] >> np.uint64(32)) * _C[2]
        h ^= h >> np.uint64(32)
        h *= _C[3]
        h ^= h >> np.uint64(29)
        span, have = WINDOW - GRAM + 1, 1
        while have < span:
            step = min(have, span - have)
            h = np.minimum(h[: len(h) - step], h[step:])
            have += step
        out[a : a + len(h)] = h
    return out


def segments(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shard hash, row, first byte, bytes) of the segments of all rows."""
    h = _smallest(buf)
    if not len(h):
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z
    valid = np.ones(len(buf) + 1, bool)
    valid[-1] = False
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        valid[max(a, b - WINDOW + 1) : b] = False
    valid = valid[: len(h) + 1]
    valid[-1] = False
    change = np.ones(len(h) + 1, bool)
    change[1:-1] = h[1:] != h[:-1]
    change[1:] |= ~valid[:-1]
    first = np.flatnonzero(valid[:-1] & change[:-1])
    last = np.flatnonzero(valid[:-1] & (change[1:] | ~valid[1:]))
    return tk.mix(h[first]), np.searchsorted(off, first, "right") - 1, first, last - first + WINDOW


def _scan(bits, doc_bits):
    """Strings of all segments: by hash, and by document (a negative bucket) where a slice has the string in two documents."""

    def rows(stream):
        for rb in stream:
            col = rb.column(0)
            ids, known = col.fill_null(-1).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)
            for a, b, buf, off in tk.text_slices(rb, "text"):
                h, row, at, _ = segments(buf, off)
                ok = known[a:b][row]
                h, row, at = h[ok], row[ok], at[ok]
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")
                h, doc, pos = h[order], ids[a:b][row][order], (at - off[row]).astype(np.uint32)[order]
                cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                many = np.minimum.reduceat(doc, cut) < np.maximum.reduceat(doc, cut)
                shared = np.repeat(many, np.diff(np.append(cut, len(h))))
                if many.any():
                    yield from ((-1 - k, x) for k, x in bl.to_documents(doc[shared], doc_bits, pos[shared]))
                mark = np.zeros(len(h), bool)
                mark[cut[many]] = True
                keep = np.flatnonzero(~shared | mark)
                yield from bl.by_bucket(bl.high_bits(h[keep], bits), h[keep], doc[keep], np.where(mark[keep], _MARK, pos[keep]).astype(np.uint32), delta=(0,))

    return lambda stream: bl.batches(rows(stream))


def _meet(doc_bits):
    """Of a range of hashes: (document, first byte) of the segments whose string is in several documents."""

    def work(bucket, held):
        if bucket < 0:
            yield from ((-1 - bucket, b) for b in held)
            return
        h, doc, pos = bl.joined(held)
        order = np.argsort(h, kind="stable")
        h, doc, pos = h[order], doc[order], pos[order]
        cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        many = (np.minimum.reduceat(doc, cut) < np.maximum.reduceat(doc, cut)) | (np.maximum.reduceat(pos, cut) == _MARK)
        hit = np.repeat(many, np.diff(np.append(cut, len(h)))) & (pos != _MARK)
        if hit.any():
            yield from bl.to_documents(doc[hit], doc_bits, pos[hit])

    each = bl.each_bucket(work)
    return lambda stream: bl.batches(each(stream))


def _hot(buf, h, doc, at, size):
    """Which segments a smaller document of this slice covers, where a segment is in more than HOT."""
    order = np.argsort(h, kind="stable")
    cut = np.append(np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]])), len(h))
    gone = np.zeros(len(h), bool)
    for k in np.flatnonzero(np.diff(cut) > HOT).tolist():
        own: dict[bytes, list[int]] = {}
        for i in order[cut[k] : cut[k + 1]].tolist():
            own.setdefault(buf[at[i] : at[i] + size[i]].tobytes(), []).append(i)
        for same in own.values():
            if len(same) > HOT:
                same = np.array(same)
                gone[same[doc[same] > doc[same].min()]] = True
    return gone


def _deal(bits, doc_bits):
    """The bytes of a group's shared segments, by shard."""

    def work(docs: pa.Table, held: pa.Table) -> pa.Table:
        out, got = [], held.column("block").to_pylist()
        if got:
            d, p = bl.joined(got)
            want = np.unique(tk.mix(d.view(np.uint64), 4) + p)
        for rb in docs.combine_chunks().to_batches() if got else ():
            col = rb.column(rb.schema.get_field_index("doc_id"))
            ids, known = col.fill_null(-1).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)
            for a, b, buf, off in tk.text_slices(rb, "text"):
                h, row, at, size = segments(buf, off)
                doc, pos = ids[a:b][row], at - off[row]
                key = tk.mix(doc.astype(np.int64).view(np.uint64), 4) + pos.astype(np.uint64)
                ok = (want[np.minimum(np.searchsorted(want, key), len(want) - 1)] == key) & known[a:b][row]
                h, doc, pos, at, size = h[ok], doc[ok], pos[ok], at[ok], size[ok]
                tag = tk.tags(buf, off, row[ok])
                gone = _hot(buf, h, doc, at, size)
                if gone.any():
                    out += ((-1 - k, x) for k, x in _ranges(doc_bits, doc[gone], pos[gone], pos[gone] + size[gone], tag[gone]))
                keep = np.flatnonzero(~gone)
                keep = keep[np.argsort(h[keep], kind="stable")]
                bucket = bl.high_bits(h[keep], bits)
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keep) else np.zeros(0, int)
                for i, j in zip(cut, np.append(cut[1:], len(keep)), strict=False):
                    k = keep[i:j]
                    where, _ = tk.expand(at[k], size[k])
                    out.append((int(bucket[i]), bl.pack(h[k], doc[k], pos[k].astype(np.uint32), size[k].astype(np.uint32), tag[k], buf[where], delta=(0,))))
        return pa.Table.from_batches([bl.batch(out)])

    return work


def _ranges(doc_bits, doc, start, end, tag):
    """Blocks by document of merged ranges (document, start, end, tag)."""
    d, s, e, g = tk.merged(doc, start.astype(np.int64), end.astype(np.int64), tag)
    return bl.to_documents(d, doc_bits, s.astype(np.uint32), e.astype(np.uint32), g)


def repeats(h, doc, pos, size, tag, data) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, tag) of the ranges of a shard's segments that a smaller document covers."""
    none = (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint32))
    start = np.cumsum(size) - size
    order = np.argsort(h, kind="stable")
    cut = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]])) if len(h) else np.zeros(0, np.int64)
    if not len(cut):
        return none
    shared = np.minimum.reduceat(doc[order], cut) < np.maximum.reduceat(doc[order], cut)
    use = order[np.repeat(shared, np.diff(np.append(cut, len(h))))]
    if not len(use):
        return none
    # each different segment once, with the smallest document that has it
    ident: dict[bytes, int] = {}
    raw = memoryview(data)
    kind = np.array([ident.setdefault(bytes(raw[a:b]), len(ident)) for a, b in zip(start[use].tolist(), (start[use] + size[use]).tolist(), strict=True)])
    least = np.full(len(ident), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc[use])
    text = np.frombuffer(b"".join(ident), np.uint8)
    length = np.fromiter(map(len, ident), np.int64, len(ident))
    head = np.cumsum(length) - length
    sa = sx.suffix_array(text)
    agree = sx.common_prefixes(text, sa) >= WINDOW
    # windows: suffixes that start far enough from the end of their segment
    owner = np.repeat(np.arange(len(length)), length)
    inside = np.arange(len(text)) - head[owner] <= length[owner] - WINDOW
    run = np.cumsum(~agree)
    ok = inside[sa]
    smallest = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, run[ok], least[owner[sa[ok]]])
    decides = np.empty(len(text), np.int64)
    decides[sa] = smallest[run]
    out = []
    for part in np.array_split(np.arange(len(use)), max(1, len(use) // 50_000)):
        k, u = kind[part], use[part]
        where, which = tk.expand(head[k], length[k] - WINDOW + 1)
        hit = decides[where] < doc[u][which]
        where, which = where[hit], which[hit]
        if len(where):
            at = pos[u][which].astype(np.int64) + where - head[k][which]
            new = np.append(True, (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            out.append((doc[u][which[first]], at[first], at[last] + WINDOW, tag[u][which[first]]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else none


def _shard(doc_bits):
    def work(bucket, held):
        if bucket < 0:
            yield from ((-1 - bucket, b) for b in held)
            return
        yield from _ranges(doc_bits, *repeats(*bl.joined(held)))

    each = bl.each_bucket(work)
    return lambda stream: bl.batches(each(stream))


def _finish(with_text):
    def work(docs: pa.Table, held: pa.Table) -> pa.Table:
        found, got = {}, held.column("block").to_pylist()
        if got:
            d, s, e, g = bl.joined(got)
            d, s, e, g = tk.merged(d, s.astype(np.int64), e.astype(np.int64), g)
            cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])))
            found = {(int(d[i]), int(g[i])): (s[i:j], e[i:j]) for i, j in zip(cut, np.append(cut[1:], len(d)), strict=True)}
            ids_found = set(d.tolist())
        rows = []
        for rb in docs.combine_chunks().to_batches():
            ids = rb.column(rb.schema.get_field_index("doc_id"))
            for a, b, buf, off in tk.text_slices(rb, "text"):
                for k, doc in enumerate(ids.slice(a, b - a).to_pylist()):
                    own = buf[off[k] : off[k + 1]]
                    gone = spans = 0
                    if found and doc in ids_found and (key := (doc, zlib.crc32(own))) in found:
                        s, e = found[key]
                        mask = tk.cover(s, e, len(own))
                        gone, spans, own = int(mask.sum()), len(s), own[~mask]
                    row = {"doc_id": doc, "n_bytes": int(off[k + 1] - off[k]), "n_removed": gone, "n_spans": spans, "kept_sha256": hashlib.sha256(own).hexdigest()}
                    rows.append(row | {"kept": own.tobytes()} if with_text else row)
        names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        return pa.Table.from_pylist(rows, pa.schema(names + [("kept", pa.binary())] * with_text))

    return work


def remove_covered(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked."""
    docs = docs.select("doc_id", "text")
    total = bl.text_bytes(docs)
    doc_bits, bits = bl.bits_for(total, 4 << 20), bl.bits_for(total, 4 << 20)
    scan = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_scan(bits, doc_bits), bl.BLOCK_SCHEMA)
    shared = bl.regrouped(scan, total).mapInArrow(_meet(doc_bits), bl.BLOCK_SCHEMA)
    by_doc = bl.spread(bl.texts(docs, doc_bits), total).groupBy("bucket")
    dealt = by_doc.cogroup(bl.spread(shared, total).groupBy("bucket")).applyInArrow(bl.tidy(_deal(bits, doc_bits)), bl.BLOCK_SCHEMA)
    ranges = bl.regrouped(dealt, total).mapInArrow(_shard(doc_bits), bl.BLOCK_SCHEMA)
    return by_doc.cogroup(bl.spread(ranges, total).groupBy("bucket")).applyInArrow(bl.tidy(_finish(with_text)), OUT + ", kept binary" * with_text)
