"""Substring dedup by difference-cover anchors.

A window is WINDOW consecutive words of one document. It is a repeat when its word
sequence also starts anywhere else, in the same document or another. Every word of
a repeat is removed; all windows are judged on the input.

Method. Positions of a document whose index modulo PERIOD lies in COVER carry an
anchor: the hash of the WINDOW - PERIOD + 1 words that start there. COVER is a
difference cover, so for any two positions i, j some shift below PERIOD makes both
i + shift and j + shift cover positions; two equal windows therefore share an
aligned anchor that lies inside both. 1. Anchors meet by hash; those that occur
once end here. 2. The windows around each shared anchor are extended to full
length: their hashes meet in the same way. 3. Each document drops the words of the
windows that met.

Scale. Anchors and windows travel as packed blocks by hash range. A hash that a
slice of text holds twice is known to repeat, so the slice sends one marker for it:
a passage in a third of all documents costs one row a slice, not one a copy. Hashes
of windows have 80 bits: at 10^13 candidate windows a few may meet by chance.

Defined cases: null or empty text has no words and keeps nothing (hash of the empty
string). Documents shorter than a window keep all their words. Every row is a document
of its own, whatever its doc_id, null included: blocks name a row by its id (-1 for
null) and a checksum of its text. Repeats of a whole row (same id, same text) count as
two places and remove each other. An empty table gives no rows. Other columns, whatever
their names, are ignored.

`rewritten` is for pipelines: of each repeated window the first place stays, by doc_id,
text and position, and a text that loses words keeps its line breaks.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import textkit as tk

WINDOW = 35
#: Bytes of text handled at once; below 2**21, so that the tables of powers stay at 32 MB a worker.
SLICE = 2_000_000
#: A perfect difference set: every residue modulo 21 is a difference of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _once(h: np.ndarray, h2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and of each ordered row whether its hash occurs again here."""
    order = np.argsort(h, kind="stable") if h2 is None else np.lexsort((h2, h))
    s = h[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    if h2 is not None:
        t = h2[order]
        same[1:-1] &= t[1:] == t[:-1]
    return order, same[1:] | same[:-1]


#: A position no word has: "this hash repeats in the slice".
_MARK = np.uint32(0xFFFFFFFF)


def _send(h, h2, doc, pos, tag, bits, doc_bits, first=False):
    """Rows of a slice: by hash those that are alone here and one marker for those that are not;
    by document (a negative bucket) the places of the latter. With first, the smallest place of
    equal ones goes by hash itself, and only the others are known to repeat."""
    order, again = _once(h, h2)
    lone = order[~again]
    many = order[again]
    if len(many) and first:
        many = many[np.lexsort((pos[many], tag[many], doc[many], h2[many], h[many]))]
    mark = np.zeros(len(lone), bool)
    if len(many):
        lead = np.ones(len(many), bool)
        lead[1:] = h[many[1:]] != h[many[:-1]]
        if h2 is not None:
            lead[1:] |= h2[many[1:]] != h2[many[:-1]]
        known = many[~lead] if first else many
        cols = (pos[known],) if tag is None else (pos[known], tag[known])
        yield from ((-1 - b, x) for b, x in bl.to_documents(doc[known], doc_bits, *cols))
        many = many[lead]
        mark = np.concatenate([mark, np.full(len(many), not first)])
    keep = np.concatenate([lone, many])
    by = np.argsort(h[keep], kind="stable")
    keep, mark = keep[by], mark[by]
    cols = h[keep], np.where(mark, 0, doc[keep]), np.where(mark, _MARK, pos[keep]).astype(np.uint32)
    if h2 is not None:
        cols += h2[keep], np.where(mark, 0, tag[keep]).astype(np.uint32)
    yield from bl.by_bucket(bl.high_bits(h[keep], bits), *cols, delta=(0,))


def _meet(doc_bits, first=False):
    """Of a hash bucket: the places whose hash occurs more than once, by document; with first, without the smallest of each."""

    def work(bucket, held):
        if bucket < 0:  # places that are known to repeat
            yield from ((-1 - bucket, b) for b in held)
            return
        h, doc, pos, *rest = bl.joined(held)
        order, again = _once(h, rest[0] if rest else None)
        hit = order[again]
        if first and len(hit):
            h2, tag = rest
            hit = hit[np.lexsort((pos[hit], tag[hit], doc[hit], h2[hit], h[hit]))]
            hit = hit[np.append(False, (h[hit[1:]] == h[hit[:-1]]) & (h2[hit[1:]] == h2[hit[:-1]]))]
        hit = hit[pos[hit] != _MARK]
        if len(hit):
            yield from bl.to_documents(doc[hit], doc_bits, pos[hit], *(x[hit] for x in rest[1:]))

    each = bl.each_bucket(work)
    return lambda stream: bl.batches(each(stream))


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word position) of the anchors of all rows that hold a window."""
    starts, ends, first = tk.words(buf, off)
    short = WINDOW - PERIOD + 1
    h = tk.window_hashes(tk.span_hashes(buf, starts, ends), short)
    n = np.diff(first)
    at, row = tk.expand(first[:-1], np.where(n >= WINDOW, n - short + 1, 0))
    pos = at - first[row]
    keep = np.isin(np.arange(PERIOD), COVER)[pos % PERIOD]
    return h[at[keep]], row[keep], pos[keep]


def around(pos: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that hold an anchor at one of pos."""
    last = n_words - WINDOW
    if last < 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(tk.cover(np.maximum(pos.astype(np.int64) - PERIOD + 1, 0), np.minimum(pos.astype(np.int64), last) + 1, last + 1))


def _by_doc(held: pa.Table) -> dict[int, list[np.ndarray]]:
    """Of each document (position, ...) of its blocks."""
    got = held.column("block").to_pylist()
    if not got:
        return {}
    doc, *rest = bl.joined(got)
    order = np.argsort(doc, kind="stable")
    doc, rest = doc[order], [x[order] for x in rest]
    cut = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else [], len(doc)).astype(np.int64)
    return {int(doc[a]): [x[a:b] for x in rest] for a, b in zip(cut[:-1], cut[1:], strict=True)}


def _of_row(found: dict, doc: int | None, text: bytes) -> np.ndarray | None:
    """Starts of the repeated windows of a row."""
    mine = found.get(-1 if doc is None else doc)
    return None if mine is None else mine[0][mine[1] == zlib.crc32(text)]


def _scan(bits, doc_bits):
    def rows(stream):
        for rb in stream:
            ids = rb.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b, buf, off in tk.text_slices(rb, "text", SLICE):
                h, row, pos = anchors(buf, off)
                yield from _send(h, None, ids[a:b][row], pos.astype(np.uint32), None, bits, doc_bits)

    return lambda stream: bl.batches(rows(stream))


def _slices(table: pa.Table, id_column: str = "doc_id", text: str = "text"):
    """(ids, texts' bytes, offsets) of a group of documents, some MB at a time."""
    for rb in table.combine_chunks().to_batches():
        ids = rb.column(rb.schema.get_field_index(id_column))
        for a, b, buf, off in tk.text_slices(rb, text, SLICE):
            yield ids.slice(a, b - a), buf, off


def _extend(bits, doc_bits, id_column, text, first_stays):
    def work(docs: pa.Table, held: pa.Table) -> pa.Table:
        found, out = _by_doc(held), []
        for ids, buf, off in _slices(docs, id_column, text) if found else ():
            starts, ends, first = tk.words(buf, off)
            words = tk.span_hashes(buf, starts, ends)
            h, h2 = tk.window_hashes(words, WINDOW, 1), tk.window_hashes(words, WINDOW, 2)
            at, doc, pos, row = [], [], [], []
            for k, d in enumerate(ids.to_pylist()):
                d = -1 if d is None else d
                if d in found and len(s := around(found[d][0], int(first[k + 1] - first[k]))):
                    at.append(first[k] + s)
                    doc.append(np.full(len(s), d))
                    pos.append(s.astype(np.uint32))
                    row.append(np.full(len(s), k))
            if at:
                at, doc, pos, row = map(np.concatenate, (at, doc, pos, row))
                out += _send(h[at], (h2[at] >> np.uint64(48)).astype(np.uint16), doc, pos, tk.tags(buf, off, row), bits, doc_bits, first_stays)
        return pa.Table.from_batches([bl.batch(out)])

    return work


def kept(text: bytes, starts: np.ndarray) -> tuple[int, int, bytes]:
    """(words, words removed, what stays) of a text, from the starts of its repeated windows."""
    w = text.split()
    if not len(starts):
        return len(w), 0, b" ".join(w)
    gone = tk.cover(starts.astype(np.int64), starts.astype(np.int64) + WINDOW, len(w))
    return len(w), int(gone.sum()), b" ".join([w[i] for i in np.flatnonzero(~gone).tolist()])


def without(text: bytes, starts: np.ndarray) -> bytes:
    """A text without the words of its repeated windows. Between the words around a gap stands the one of their
    white spaces with more line breaks, so lines stay lines."""
    spans = [m.span() for m in _WORD.finditer(text)]
    gone = tk.cover(starts.astype(np.int64), starts.astype(np.int64) + WINDOW, len(spans))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = [], 0
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # words i .. j - 1 go
        before = text[spans[i - 1][1] if i else 0 : spans[i][0]]
        after = text[spans[j - 1][1] : spans[j][0] if j < len(spans) else len(text)]
        out.append(text[at : spans[i][0] - len(before)])
        out.append(after if not i or after.count(b"\n") > before.count(b"\n") else before if j < len(spans) else b"")
        at = spans[j - 1][1] + len(after)
    return b"".join([*out, text[at:]]) if edge.size else text


def _finish(with_text):
    def work(docs: pa.Table, held: pa.Table) -> pa.Table:
        found, none, rows = _by_doc(held), np.zeros(0, np.uint32), []
        for ids, buf, off in _slices(docs):
            raw = buf.tobytes()
            for k, d in enumerate(ids.to_pylist()):
                own = raw[off[k] : off[k + 1]]
                starts = _of_row(found, d, own)
                n, gone, rest = kept(own, none if starts is None else starts)
                row = {"doc_id": d, "n_words": n, "n_removed": gone, "kept_sha256": hashlib.sha256(rest).hexdigest()}
                rows.append(row | {"kept_text": rest.decode()} if with_text else row)
        names = [pa.field("doc_id", pa.int64()), pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("kept_sha256", pa.string())]
        return pa.Table.from_pylist(rows, pa.schema(names + [pa.field("kept_text", pa.string())] * with_text))

    return work


def _repeats(docs: DataFrame, by_doc, doc_bits: int, total: int, id_column: str = "doc_id", text: str = "text", first_stays: bool = False) -> DataFrame:
    """Blocks of (document, start, tag) of all repeated windows; by_doc: the documents (with these names), grouped by bucket."""
    bits = bl.bits_for(total, 6 << 20)
    scan = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_scan(bits, doc_bits), bl.BLOCK_SCHEMA)
    shared = bl.regrouped(scan, total).mapInArrow(_meet(doc_bits), bl.BLOCK_SCHEMA)
    full = by_doc.cogroup(bl.spread(shared, total).groupBy("bucket")).applyInArrow(bl.tidy(_extend(bits, doc_bits, id_column, text, first_stays)), bl.BLOCK_SCHEMA)
    return bl.regrouped(full, total).mapInArrow(_meet(doc_bits, first_stays), bl.BLOCK_SCHEMA)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and kept_text if asked."""
    docs = docs.select("doc_id", "text")
    total = bl.text_bytes(docs)
    doc_bits = bl.bits_for(total, 4 << 20)
    by_doc = bl.spread(bl.texts(docs, doc_bits), total).groupBy("bucket")
    repeats = _repeats(docs, by_doc, doc_bits, total)
    return by_doc.cogroup(bl.spread(repeats, total).groupBy("bucket")).applyInArrow(bl.tidy(_finish(with_text)), OUT + ", kept_text string" * with_text)


def rewritten(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeats taken out of `text` (and `n_chars`, if there is one, set to its new length).

    The first place of a repeated window keeps its words: the smallest by doc_id (null as -1), text
    checksum and position. Texts that lose nothing stay as they are; the others keep their lines.
    """
    total = bl.text_bytes(docs)
    doc_bits = bl.bits_for(total, 4 << 20)
    names = [f"c{k}" for k in range(len(docs.columns))]  # any column name may clash with ours or hold a dot
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*names).withColumns({own["doc_id"]: F.col(own["doc_id"]).cast("long"), own["text"]: F.col(own["text"]).cast("string")})
    schema = rows.schema
    by_doc = bl.spread(rows.withColumn("bucket", bl.doc_bucket_sql(own["doc_id"], doc_bits)), total).groupBy("bucket")
    repeats = _repeats(docs, by_doc, doc_bits, total, own["doc_id"], own["text"], True)

    def work(group: pa.Table, held: pa.Table) -> pa.Table:
        found, texts = _by_doc(held), []
        group = group.combine_chunks()
        for d, text in zip(group.column(own["doc_id"]).to_pylist(), group.column(own["text"]).to_pylist(), strict=True):
            starts = _of_row(found, d, text.encode()) if text else None
            texts.append(text if starts is None or not len(starts) else without(text.encode(), starts).decode())
        out = group.set_column(group.column_names.index(own["text"]), own["text"], pa.array(texts, pa.string()))
        if "n_chars" in own:
            k = group.column_names.index(own["n_chars"])
            out = out.set_column(k, own["n_chars"], pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(group.schema.field(k).type))
        return out.select(names)

    return by_doc.cogroup(bl.spread(repeats, total).groupBy("bucket")).applyInArrow(bl.tidy(work), schema).toDF(*docs.columns)
