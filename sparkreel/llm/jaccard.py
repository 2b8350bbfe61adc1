"""Exact Jaccard similarity join of word shingles, and its components.

A document's set holds its distinct shingles of SHINGLE lower-cased words. Two documents
link when 100 * |A and B| >= THRESHOLD * |A or B|; the Jaccard distance 1 - J is a metric,
and links are pairs at distance 0.25 or less.

Method. Pivots are documents, and regions are the documents near a pivot:
1. Sets are ordered by one global order of shingles (frequent ones last). Documents that
   link share one of their first n - ceil(0.75 n) + 1 shingles. For each such shingle, the
   smallest document that leads with it (among those of like size) is the pivot of all that
   do. A document goes to the regions of all its pivots, so a document near the border of
   two regions is in both and no link falls between regions.
2. In a region, distances to the pivot are computed exactly. Documents within 0.25 link to
   it, and are one component. For the others, further pivots are chosen in the region; each
   is compared exactly with the documents in its triangle-inequality window,
   |d(x, p) - d(y, p)| <= 0.25. A large region is split again by the same rule, with the
   region's own shingle counts as the order.
3. The links of all regions form the components.

The order puts frequent shingles last: those that scan tasks see in HOT_DOCS documents or
more, the FREQUENT most common of them at most, as a bitmap of 2**LATE_BITS bits by hash (2 MB
at any input size, sent to the tasks). Any bitmap gives the same links: it is only an order,
which keeps a passage in many documents from making a region.
Of a shared leading shingle, those documents need no region whose place of it is beyond the
first seventh of their set, unless a smaller set has it there (if it is the first that two
sets share, the rest of the smaller must still hold 6/7 of it).

Scale. Shuffles carry packed blocks: a quarter of the shingle hashes, the sets of documents
that share a pivot, and the texts once. Equal sets of a slice of text are one document
there. A region holds the documents that share a leading, infrequent shingle.
Shingles are compared by 52-bit hashes: in a pair of sets of 1000, a false match has a chance
of about 2e-10.

Defined cases: null or empty text, or white space only, has no shingles and no links. A
null doc_id has no links and a null component. Rows with the same doc_id are one node with
the links of each. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import small_side
from . import blocks as bl
from . import textkit as tk
from .components import components

SHINGLE, THRESHOLD = 5, 75
HOT_DOCS, FREQUENT, LATE_BITS = 2, 1 << 22, 24
SPLIT = 64
#: A region of more members than this (counted once for each shingle they share) is joined by several tasks, in parts of
#: about as many; so many that no more than LARGE regions are.
PART, LARGE = 512, 1 << 19
#: Distances to a pivot are kept in so many steps.
STEPS = 16
#: Buckets from here on hold identities of sets, not shingles; and parts of large regions, not regions.
IDENTITY, PARTS = 1 << 40, 1 << 62
#: A set's hashes have 64 - ROW_BITS bits; their low bits are 0.
ROW_BITS = 12

#: Bytes of text handled at once; below 2**21, so that the tables of powers stay at 32 MB a worker.
SLICE = 2_000_000

_SCAN = "doc_id long, n_shingles long, h long, df long"


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending inside each row, offsets of rows) of the rows' sets."""
    low = buf.copy()
    low[(buf >= 65) & (buf <= 90)] += 32
    starts, ends, first = tk.words(low, off)
    words, n = tk.span_hashes(low, starts, ends), np.diff(first)
    at, row = tk.expand(first[:-1], np.maximum(n - SHINGLE + 1, 0))
    h = tk.window_hashes(words, SHINGLE)[at]
    for width in range(1, SHINGLE):
        few = np.flatnonzero(n == width)
        if len(few):
            h = np.concatenate([h, tk.window_hashes(words, width, width)[first[few]]])
            row = np.concatenate([row, few])
    # one sort: the row in the high bits, the hash below
    key = np.sort((row.astype(np.uint64) << np.uint64(64 - ROW_BITS)) | (h >> np.uint64(ROW_BITS)))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key << np.uint64(ROW_BITS), np.searchsorted(key >> np.uint64(64 - ROW_BITS), np.arange(len(off)).astype(np.uint64))


def _slices(rb: pa.RecordBatch):
    """Slices of at most 2**ROW_BITS rows."""
    for k in range(0, rb.num_rows, 1 << ROW_BITS):
        for a, b, buf, off in tk.text_slices(rb.slice(k, 1 << ROW_BITS), "text", SLICE):
            yield a + k, b + k, buf, off


def lead(n: np.ndarray) -> np.ndarray:
    """How many first shingles of a set of n must be looked at."""
    return np.where(n > 0, n - -(-THRESHOLD * n // 100) + 1, 0)


def like_size(n: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Starts of runs (ordered by group, then n) across which no two sets can link."""
    return np.append(True, (group[1:] != group[:-1]) | (100 * n[:-1] < THRESHOLD * n[1:])) if len(n) else np.zeros(0, bool)


def _census(stream):
    """Per document its size, per task its frequent shingles."""
    held: list[np.ndarray] = []
    often: list[tuple[np.ndarray, np.ndarray]] = []
    schema = pa.schema([(x.split()[0], pa.int64()) for x in _SCAN.split(", ")])

    def count():
        h = np.sort(np.concatenate(held))
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(at, len(h)))
        often.append((h[at[n >= HOT_DOCS]], n[n >= HOT_DOCS]))
        held.clear()

    for rb in stream:
        for a, b, buf, off in _slices(rb):
            h, edge = shingle_sets(buf, off)
            m = b - a
            yield pa.RecordBatch.from_arrays([rb.column(0).slice(a, m), pa.array(np.diff(edge).astype(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], schema=schema)
            held.append(h)
            if sum(map(len, held)) > 2_000_000:
                count()
    if held:
        count()
    if often:
        h, n = np.concatenate([x[0] for x in often]), np.concatenate([x[1] for x in often])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int64()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)
    bl.give_back()


def leading(h: np.ndarray, edge: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into h, row, place in the row's order) of each row's leading shingles; hot is the bitmap of late ones."""
    n = np.diff(edge)
    row = np.repeat(np.arange(len(n)), n)
    at = h >> np.uint64(64 - LATE_BITS)
    late = (hot[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    lates = np.append(0, np.cumsum(late))
    before = lates[:-1] - lates[edge[:-1]][row]  # late ones before it in the row
    nth = np.arange(len(h)) - edge[:-1][row]
    early = (n - (lates[edge[1:]] - lates[edge[:-1]]))[row]
    nth = np.where(late, early + before, nth - before)
    keep = np.flatnonzero(nth < lead(n)[row])
    return keep, row[keep], nth[keep]


def identities(h: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set, the same wherever it stands in a slice."""
    out = []
    for seed in (11, 12):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(h, seed), dtype=np.uint64)])
        out.append(total[edge[1:]] - total[edge[:-1]])
    return out[0], out[1]


def equal_sets(doc: np.ndarray, k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, representative of each row in that order): the smallest document stands for all with its set."""
    by = np.lexsort((doc, k2, k1, n))
    new = np.append(True, (k1[by[1:]] != k1[by[:-1]]) | (k2[by[1:]] != k2[by[:-1]]) | (n[by[1:]] != n[by[:-1]])) if len(by) else np.zeros(0, bool)
    return by, by[np.flatnonzero(new)][np.cumsum(new) - 1]


def _lead_rows(frequent, bits, doc_bits):
    def rows(stream):
        hot = frequent.value
        for rb in stream:
            col = rb.column(0)
            ids, known = col.fill_null(-1).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)
            for a, b, buf, off in _slices(rb):
                h, edge = shingle_sets(buf, off)
                n, doc = np.diff(edge), ids[a:b]
                use = (n > 0) & known[a:b]
                # equal sets of this slice: the smallest document stands for all
                rows_ = np.flatnonzero(use)
                if not len(rows_):
                    continue
                k1, k2 = identities(h, edge)
                by, rep = equal_sets(doc[rows_], k1[rows_], k2[rows_], n[rows_])
                by, rep = rows_[by], rows_[rep]
                twin = doc[by] != doc[rep]
                if twin.any():
                    yield -1 - int(bl.doc_bucket(doc[:1], doc_bits)[0]), bl.pack(doc[by][twin], doc[rep][twin])
                one = np.unique(rep)
                use = np.zeros(len(n), bool)
                use[one] = True
                one = one[np.argsort(k1[one])]
                yield from bl.by_bucket(IDENTITY + bl.high_bits(k1[one], doc_bits), k1[one], k2[one], n[one].astype(np.uint32), doc[one], delta=(0,))
                at, row, nth = leading(h, edge, hot)
                keep = use[row]
                at, row, nth = at[keep], row[keep], nth[keep]
                order = np.argsort(h[at])
                at, row, nth = at[order], row[order], nth[order]
                size = n[row].astype(np.uint32)
                yield from bl.by_bucket(bl.high_bits(h[at], bits), h[at], doc[row], size, (7 * nth <= size).astype(np.uint8), delta=(0,))

    return lambda stream: bl.batches(rows(stream))


_PAIRS = pa.schema([("bucket", pa.int64()), ("block", pa.binary()), ("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    """Rows of _PAIRS with these columns, the others null."""
    m = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(m, f.type) for f in _PAIRS], schema=_PAIRS)


def _pivots(doc_bits):
    """Of a range of shingles: blocks of (document, pivot, 0) for those that share a leading shingle, and the members
    of each pivot (u, n). Of a range of identities: links (u, v) of equal sets, and blocks of (document, identity, 1)
    for those that another stands for."""

    def _to_documents(doc, value, kind):
        rows = list(bl.to_documents(doc, doc_bits, value, np.full(len(doc), kind, np.uint8)))
        yield _rows(bucket=[r[0] for r in rows], block=[r[1] for r in rows])

    def work(bucket, held):
        if bucket < 0:
            u, v = bl.joined(held)
            yield _rows(u=u, v=v)
            return
        if bucket >= IDENTITY:
            k1, k2, n, doc = bl.joined(held)
            by, rep = equal_sets(doc, k1, k2, n)
            twin = doc[by] != doc[rep]
            by, rep = by[twin], rep[twin]
            if len(by):
                yield from _to_documents(doc[by], k1[by].view(np.int64), 1)
                yield _rows(u=doc[by], v=doc[rep])
            return
        h, doc, n, early = bl.joined(held)
        order = np.argsort(h)
        s = h[order]
        again = np.append(False, s[1:] == s[:-1])
        again[:-1] |= again[1:]
        order = order[again]
        if not len(order):
            return
        h, doc, n, early = h[order], doc[order], n[order].astype(np.int64), early[order] == 1
        by = np.lexsort((~early, n, h))
        h, doc, n, early = h[by], doc[by], n[by], early[by]
        # the smaller set of a pair must have the first shared shingle in its first seventh
        cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        seen = np.cumsum(early)
        ok = seen - np.repeat(seen[cut] - early[cut], np.diff(np.append(cut, len(h)))) > 0
        if not ok.any():
            return
        h, doc, n = h[ok], doc[ok], n[ok]
        cut = np.flatnonzero(like_size(n, h))
        size = np.diff(np.append(cut, len(h)))
        pivot = np.repeat(np.minimum.reduceat(doc, cut), size)
        ok = pivot < np.repeat(np.maximum.reduceat(doc, cut), size)
        x, p = doc[ok], pivot[ok]
        if len(x):
            pair = np.unique(np.stack([x, p], 1), axis=0)
            yield from _to_documents(pair[:, 0], pair[:, 1], 0)
            own, n = np.unique(pair[:, 1], return_counts=True)
            yield _rows(u=own, n=n)

    return bl.each_bucket(work)


def part_key(region: np.ndarray, *numbers) -> np.ndarray:
    """Bucket of a part of a large region."""
    h = tk.mix(region.astype(np.int64).view(np.uint64), 6)
    for k, x in enumerate(numbers):
        h = tk.mix(h + np.asarray(x).astype(np.uint64), 30 + k)
    return (h >> np.uint64(2)).astype(np.int64) | PARTS


def _hashed(doc: np.ndarray, seed: int) -> np.ndarray:
    return (tk.mix(doc.astype(np.int64).view(np.uint64), seed) >> np.uint64(2)).astype(np.int64)


def home(x: np.ndarray, p: np.ndarray, large: np.ndarray, parts: np.ndarray, region_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of a pair of document and pivot, bucket): of a large region one part by the document, for the pivot itself all parts."""
    bucket = bl.high_bits(tk.mix(p.view(np.uint64), 6), region_bits)
    if not len(large):
        return np.arange(len(p)), bucket
    at = np.minimum(np.searchsorted(large, p), len(large) - 1)
    n = np.where(large[at] == p, parts[at], 0)
    nth, which = tk.expand(np.zeros(len(p)), np.where((x == p) & (n > 0), n, 1))
    part = np.where(x == p, 0, _hashed(x, 8) % np.maximum(n, 1))[which] + nth
    return which, np.where(n[which] > 0, part_key(p[which], part), bucket[which])


def _sent(region, role, bucket, row, doc, h, edge):
    """Blocks of members (region, role) and their sets, by bucket; each set once in a block, however many regions want it."""
    by = np.argsort(bucket, kind="stable")
    bucket, region, role, row = bucket[by], region[by], role[by], row[by]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for i, j in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
        u, back = np.unique(row[i:j], return_inverse=True)
        where, _ = tk.expand(edge[u], edge[u + 1] - edge[u])
        yield int(bucket[i]), bl.pack(region[i:j], back.astype(np.uint32), doc[u], (edge[u + 1] - edge[u]).astype(np.uint32), np.diff(h[where] >> np.uint64(ROW_BITS), prepend=np.uint64(0)), role[i:j])


def _members(region_bits, regions):
    """The sets of a group's documents, by region; regions: the large ones and their parts."""

    def work(docs: pa.Table, held: pa.Table) -> pa.Table:
        large, parts = regions.value
        got, out = held.column("block").to_pylist(), []
        if got:
            x, p, kind = bl.joined(got)
            gone, stood = set(zip(x[kind == 1].tolist(), p[kind == 1].tolist(), strict=True)), np.unique(x[kind == 1])
            x, p = x[kind == 0], p[kind == 0]
            pair = np.unique(np.stack([x, p], 1), axis=0)
            x, p = pair[:, 0], pair[:, 1]
        for rb in docs.combine_chunks().to_batches() if got else ():
            col = rb.column(rb.schema.get_field_index("doc_id"))
            ids, known = col.fill_null(-1).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)
            for a, b, buf, off in _slices(rb):
                doc = ids[a:b]
                lo, hi = np.searchsorted(x, doc), np.searchsorted(x, doc, "right")
                hi = np.where(known[a:b], hi, lo)
                if not (hi > lo).any():
                    continue
                h, edge = shingle_sets(buf, off)
                if gone:  # another document with the same set is in its regions
                    k1 = identities(h, edge)[0].view(np.int64)
                    hi = np.where([bool(m) and (d, k) in gone for m, d, k in zip(np.isin(doc, stood).tolist(), doc.tolist(), k1.tolist(), strict=True)], lo, hi)
                    if not (hi > lo).any():
                        continue
                at, row = tk.expand(lo, hi - lo)
                which, bucket = home(x[at], p[at], large, parts, region_bits)
                at, row = at[which], row[which]
                out += _sent(p[at], np.zeros(len(at), np.uint8), bucket, row, doc, h, edge)
        return pa.Table.from_batches([bl.batch(out)])

    return work


class Sets:
    """Documents and their sets (ascending hashes); `at` are their places in the label list of their region."""

    def __init__(self, doc: np.ndarray, size: np.ndarray, h: np.ndarray, at: np.ndarray | None = None, label: np.ndarray | None = None):
        self.doc, self.size, self.h = doc, size.astype(np.int64), h
        self.at = np.arange(len(doc)) if at is None else at
        self.label = np.arange(len(doc)) if label is None else label  # shared by all parts of a region
        self.edge = np.append(0, np.cumsum(self.size))
        self.code: np.ndarray | None = None  # the hashes as small numbers

    def coded(self) -> None:
        """For many overlaps: shingles are looked up by number then."""
        names, code = np.unique(self.h, return_inverse=True)
        self.code, self.mark = code.astype(np.int32), np.zeros(len(names), np.bool_)

    def one_overlap(self, r: int, which: np.ndarray) -> np.ndarray:
        """overlap with the set of row r."""
        if self.code is None:
            return self.overlap(self.of(r), which)
        own = self.code[self.edge[r] : self.edge[r + 1]]
        self.mark[own] = True
        where, _ = tk.expand(self.edge[which], self.size[which])
        hits = np.append(0, np.cumsum(self.mark[self.code[where]], dtype=np.int64))
        self.mark[own] = False
        end = np.cumsum(self.size[which])
        return hits[end] - hits[end - self.size[which]]

    def of(self, k: int) -> np.ndarray:
        return self.h[self.edge[k] : self.edge[k + 1]]

    def some(self, which: np.ndarray) -> Sets:
        where, _ = tk.expand(self.edge[which], self.size[which])
        return Sets(self.doc[which], self.size[which], self.h[where], self.at[which], self.label)

    def one(self) -> bool:
        """Whether all are known to be one component."""
        mine = self.label[self.at]
        return bool((mine == mine[0]).all()) if len(mine) else True

    def join(self, which: np.ndarray) -> None:
        """Notes that these are one component."""
        mine = np.unique(self.label[self.at[which]])
        if len(mine) > 1:
            self.label[np.isin(self.label, mine[1:])] = mine[0]

    def star(self, r: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of row r to these that are needed for its component, one for each component among them; notes them."""
        of = self.label[self.at[which]]
        one = which[np.unique(of, return_index=True)[1]] if len(which) else which
        one = one[self.label[self.at[one]] != self.label[self.at[r]]]
        self.join(np.append(one, r))
        return self.doc[one], np.full(len(one), self.doc[r])

    def overlap(self, own: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Size of the intersection of a set with each of `which`."""
        if not len(which):
            return np.zeros(0, np.int64)
        where, row = tk.expand(self.edge[which], self.size[which])
        v = self.h[where]
        hit = own[np.minimum(np.searchsorted(own, v), len(own) - 1)] == v
        return np.bincount(row, hit, len(which)).astype(np.int64)


def linked(inter, n, m):
    return 100 * inter >= THRESHOLD * (n + m - inter)


def region_links(s: Sets, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among the documents of a region with pivot `first`, enough of them for its components: pairs that links connect already are not compared."""
    m = len(s.doc)
    if s.one():
        return []
    inter = s.overlap(s.of(first), np.arange(m))
    near = linked(inter, s.size, s.size[first])
    near[first] = True
    out = [s.star(first, np.flatnonzero(near))]
    rest = np.flatnonzero(~near)
    if len(rest) > SPLIT:
        return out + _split(s, near, first)
    far = 1 - inter / (s.size + s.size[first] - inter)  # distance to the pivot
    todo = np.ones(m, bool)
    todo[first] = False
    for r in rest.tolist():
        todo[r] = False
        out.append(_against(s, r, todo & (np.abs(far - far[r]) <= 1 - THRESHOLD / 100 + 1e-9)))
    return out


def _against(s: Sets, r: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one document with those among the others whose size allows it, a few more at a time, as each link spares its component."""
    window = np.flatnonzero(among & (100 * np.minimum(s.size, s.size[r]) >= THRESHOLD * np.maximum(s.size, s.size[r])))
    out, take = [np.zeros(0, np.int64)], 16
    while len(window := window[s.label[s.at[window]] != s.label[s.at[r]]]):
        some, window, take = window[:take], window[take:], 2 * take
        got = some[linked(s.one_overlap(r, some), s.size[some], s.size[r])]
        out.append(s.star(r, got)[0])
    got = np.concatenate(out)
    return got, np.full(len(got), s.doc[r])


def _split(s: Sets, near: np.ndarray, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of all documents that are not near the pivot, by regions inside this region."""
    m, out = len(s.doc), []
    row = np.repeat(np.arange(m), s.size)
    _, code, df = np.unique(s.h, return_inverse=True, return_counts=True)
    order = np.lexsort((code, df[code], row))
    keep = (np.arange(len(row)) - s.edge[row] < lead(s.size)[row]) & (row != first)
    code, row = code[order[keep]], row[keep]
    by = np.lexsort((s.size[row], code))
    code, row = code[by], row[by]
    cut = np.flatnonzero(like_size(s.size[row], code))
    size = np.diff(np.append(cut, len(row)))
    useful = np.repeat((np.maximum.reduceat(row, cut) > np.minimum.reduceat(row, cut)) & np.logical_or.reduceat(~near[row], cut), size)
    pivot = np.repeat(np.minimum.reduceat(row, cut), size)
    pair = np.unique(np.stack([pivot[useful], row[useful]], 1), axis=0)
    cut = np.flatnonzero(np.append(True, pair[1:, 0] != pair[:-1, 0])) if len(pair) else np.zeros(0, int)
    for a, b in zip(cut, np.append(cut[1:], len(pair)), strict=False):
        who = pair[a:b, 1]
        if (s.label[s.at[who]] == s.label[s.at[who[0]]]).all():
            continue
        sub = s.some(who)
        if len(who) <= 0.9 * m:
            out += region_links(sub, int(np.searchsorted(who, pair[a, 0])))
            continue
        sub.coded()
        for r in np.flatnonzero(~near[who]).tolist():
            out.append(_against(sub, r, np.ones(len(who), bool)))
    return out


def _held_sets(held) -> tuple[np.ndarray, np.ndarray, np.ndarray, Sets]:
    """(region, role, member, sets) of the blocks of a bucket, ordered by region and document."""
    parts = [bl.unpack(b) for b in held]
    shift = np.cumsum([0] + [len(p[2]) for p in parts[:-1]])
    region, role = (np.concatenate([p[k] for p in parts]) for k in (0, 5))
    member = np.concatenate([p[1].astype(np.int64) + k for p, k in zip(parts, shift, strict=True)])
    s = Sets(*(np.concatenate([p[k] for p in parts]) for k in (2, 3)), np.concatenate([np.cumsum(p[4], dtype=np.uint64) for p in parts]))
    _, s.at = np.unique(s.doc, return_inverse=True)  # rows with the same doc_id are one node
    s.label = np.arange(int(s.at.max()) + 1)
    by = np.lexsort((s.doc[member], region))
    return region[by], role[by], member[by], s


def _runs(region: np.ndarray):
    cut = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
    return zip(cut, np.append(cut[1:], len(region)), strict=True)


def _joined(out: list[tuple[np.ndarray, np.ndarray]]):
    if out:
        u, v = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
        ok = u != v
        yield _rows(u=u[ok], v=v[ok])


def _regions(doc_bits):
    """Links of the regions of a bucket. Of a part of a large region only those to the pivot; besides, blocks of
    (document, region, step of its distance, role) for all members, the members by step (u region, v step, n), and
    those that are not near the pivot (u document, v region, n: step - STEPS, so negative)."""

    def work(bucket, held):
        region, _, member, s = _held_sets(held)
        out = []
        for a, b in _runs(region):
            own = s.some(member[a:b])
            if bucket < PARTS:
                if b - a > 1:
                    out += region_links(own, int(np.flatnonzero(own.doc == region[a])[0]) if (own.doc == region[a]).any() else 0)
                continue
            pivots = np.flatnonzero(own.doc == region[a])
            # rows that share the pivot's id: all parts take the same one
            first = min(pivots.tolist(), key=lambda k: (int(own.size[k]), own.of(k).tobytes()))
            inter = own.overlap(own.of(first), np.arange(b - a))
            near = linked(inter, own.size, own.size[first])
            near[first] = True
            out.append((own.doc[near], np.full(int(near.sum()), own.doc[first])))
            step = np.minimum((1 - inter / (own.size + own.size[first] - inter)) * STEPS, STEPS - 1).astype(np.int64)
            doc, role = own.doc, np.where(near, NEAR, FAR).astype(np.uint8)
            rows = list(bl.to_documents(doc, doc_bits, np.full(b - a, region[a]), step.astype(np.uint8), role))
            yield _rows(bucket=[r[0] for r in rows], block=[r[1] for r in rows])
            steps, n = np.unique(step, return_counts=True)
            yield _rows(u=np.full(len(steps), region[a]), v=steps, n=n)
            if not near.all():
                yield _rows(u=doc[~near], v=np.full(int((~near).sum()), region[a]), n=step[~near] - STEPS)
        yield from _joined(out)

    return bl.each_bucket(work)


#: Roles in a large region: near its pivot, far from it, and one that visits the members in its window.
NEAR, FAR, VISITOR = 0, 1, 2
#: Steps between two documents within the linking distance, and one for rounding.
WINDOW_STEPS = -(-(100 - THRESHOLD) * STEPS // 100) + 1


def _visitors(doc_bits):
    """Blocks by document of (document, region, step) rows, as visitors."""

    def rows(stream):
        for rb in stream:
            doc, region, step = (rb.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if len(doc):
                yield from bl.to_documents(doc, doc_bits, region, step.astype(np.uint8), np.full(len(doc), VISITOR, np.uint8))

    return lambda stream: bl.batches(rows(stream))


def _windows(layout):
    """The sets of a group's documents, by part of the window in which they meet.

    layout: per (region, step) the parts of its members and of its visitors. A member goes to its
    part, once for each part of visitors; a visitor to every part of members of every step within
    the triangle-inequality window of its own distance.
    """

    def places(x, region, step, role):
        keys, parts, blocks = layout.value
        i = np.repeat(np.arange(len(x)), np.where(role == VISITOR, 2 * WINDOW_STEPS + 1, 1))
        head = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        other = np.arange(len(i)) - np.repeat(head, np.diff(np.append(head, len(i)))) - np.where(role[i] == VISITOR, WINDOW_STEPS, 0)
        at = step[i].astype(np.int64) + other
        key = tk.mix(region[i].view(np.uint64), 7) + at.astype(np.uint64)
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = (at >= 0) & (at < STEPS) & (keys[k] == key)
        i, at, k = i[ok], at[ok], k[ok]
        visits = role[i] == VISITOR
        nth, which = tk.expand(np.zeros(len(i)), np.where(visits, parts[k], blocks[k]))
        i, at, k, visits = i[which], at[which], k[which], visits[which]
        part = np.where(visits, nth, _hashed(x[i], 8) % parts[k])
        block = np.where(visits, _hashed(x[i], 9) % blocks[k], nth)
        return i, part_key(region[i], at, part, block)

    def work(docs: pa.Table, held: pa.Table) -> pa.Table:
        got, out = held.column("block").to_pylist(), []
        if got:
            x, region, step, role = bl.joined(got)
            order = np.argsort(x, kind="stable")
            x, region, step, role = x[order], region[order], step[order], role[order]
        for rb in docs.combine_chunks().to_batches() if got else ():
            col = rb.column(rb.schema.get_field_index("doc_id"))
            ids, known = col.fill_null(-1).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)
            for a, b, buf, off in _slices(rb):
                doc = ids[a:b]
                lo, hi = np.searchsorted(x, doc), np.searchsorted(x, doc, "right")
                at, row = tk.expand(lo, np.where(known[a:b], hi, lo) - lo)
                if not len(at):
                    continue
                i, bucket = places(x[at], region[at], step[at], role[at])
                if len(i):
                    h, edge = shingle_sets(buf, off)
                    out += _sent(region[at[i]], role[at[i]], bucket, row[i], doc, h, edge)
        return pa.Table.from_batches([bl.batch(out)])

    return work


def _in_windows(layout):
    """The documents of blocks that have a place in the layout."""

    def run(stream):
        keys = layout.value[0]
        for rb in stream:
            for block in rb.column(1).to_pylist():
                x, region, step, role = bl.unpack(block)
                key = tk.mix(region.view(np.uint64), 7) + step.astype(np.uint64)
                placed = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(x[placed | (role == VISITOR)]))], names=["_doc"])

    return run


def _meet(_, held):
    """Links of visitors to the members of a part of a window."""
    region, role, member, s = _held_sets(held)
    out = []
    for a, b in _runs(region):
        own, mine = s.some(member[a:b]), role[a:b]
        own.coded()
        own.join(np.flatnonzero(mine == NEAR))
        for r in np.flatnonzero(mine == VISITOR).tolist():
            out.append(_against(own, r, mine != VISITOR))
    yield from _joined(out)


def _large(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(pivot, parts) of the large regions, pivots ascending; at most LARGE, as the least size follows the pairs."""
    total = int(counts.agg(F.sum("n").alias("n")).first()["n"] or 0)
    least = max(PART, -(-total // LARGE))
    rows = counts.groupBy("u").agg(F.sum("n").alias("n")).where(F.col("n") > least).toPandas().sort_values("u")
    return rows["u"].to_numpy(np.int64), -(-rows["n"].to_numpy(np.int64) // least)


def _layout(members: DataFrame, visits: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of region and step, parts of members, parts of visitors), by key, for the steps that have members and visitors in their window."""
    near = F.explode(F.sequence(F.col("step") - WINDOW_STEPS, F.col("step") + WINDOW_STEPS))
    guests = visits.groupBy("region", "step").count().select("region", near.alias("step"), F.col("count").alias("guests")).groupBy("region", "step").agg(F.sum("guests").alias("guests"))
    rows = members.groupBy("region", "step").agg(F.sum("n").alias("n")).join(guests, ["region", "step"]).toPandas()
    key = tk.mix(rows["region"].to_numpy(np.int64).view(np.uint64), 7) + rows["step"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(key)
    return key[order], *(-(-rows[c].to_numpy(np.int64)[order] // PART) for c in ("n", "guests"))


def _bitmap(counts: DataFrame) -> np.ndarray:
    """Bits of the most common of (h, df): as many as FREQUENT allows, by their count."""
    least, n = 1 << 20, 0
    for r in sorted(counts.groupBy(F.least("df", F.lit(1 << 20)).alias("df")).count().collect(), key=lambda r: -r["df"]):
        n += r["count"]
        if n > FREQUENT:
            break
        least = r["df"]
    at = F.shiftrightunsigned("h", 64 - LATE_BITS)
    words = counts.where(F.col("df") >= least).groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {64 - LATE_BITS}) & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (LATE_BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _second(spark, docs: DataFrame, joined: DataFrame, found: DataFrame, doc_bits: int, total: int) -> DataFrame:
    """Components after the second round in large regions: members far from their pivot and in no component with it visit those in their windows."""
    far = joined.where("n < 0").select(F.col("u").alias("doc"), F.col("v").alias("region"), (F.col("n") + STEPS).alias("step"))
    for side in ("doc", "region"):
        label = found.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
        far = far.join(label, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    visits = bl.cut(far.where("_doc <> _region").select("doc", "region", "step").distinct())
    if visits.isEmpty():
        return found
    layout = _layout(joined.where("n > 0").select(F.col("u").alias("region"), F.col("v").alias("step"), "n"), visits)
    layout = spark.sparkContext.broadcast(layout)
    guests = bl.cut(visits.mapInArrow(_visitors(doc_bits), bl.BLOCK_SCHEMA))  # else tasks below have two workers at once
    blocks = joined.where("bucket is not null").select("bucket", "block").union(guests)
    # texts of documents that meet anyone, and no others, are read again
    some = docs.join(small_side(blocks.mapInArrow(_in_windows(layout), "_doc long").distinct()), F.col("doc_id") == F.col("_doc"), "left_semi")
    by_doc = bl.spread(bl.texts(some, doc_bits), total).groupBy("bucket")
    sets = by_doc.cogroup(bl.spread(blocks, total).groupBy("bucket")).applyInArrow(bl.tidy(_windows(layout)), bl.BLOCK_SCHEMA)
    links = bl.regrouped(sets, total).mapInArrow(bl.each_bucket(_meet), "bucket long, block binary, u long, v long, n long").select("u", "v")
    return components(links.union(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    total = bl.text_bytes(docs)
    doc_bits, bits = bl.bits_for(total, 2 << 20), bl.bits_for(total, 12 << 20)
    census = bl.cut(docs.mapInArrow(_census, _SCAN))
    frequent = spark.sparkContext.broadcast(_bitmap(census.where("df is not null").groupBy("h").agg(F.sum("df").alias("df"))))
    leads = docs.mapInArrow(_lead_rows(frequent, bits, doc_bits), bl.BLOCK_SCHEMA)
    schema = "bucket long, block binary, u long, v long, n long"
    both = bl.cut(bl.regrouped(leads, total).mapInArrow(_pivots(doc_bits), schema))
    large = _large(both.where("n is not null").select("u", "n"))
    by_doc = bl.spread(bl.texts(docs, doc_bits), total).groupBy("bucket")
    pairs = both.where("bucket is not null").select("bucket", "block")
    sets = by_doc.cogroup(bl.spread(pairs, total).groupBy("bucket")).applyInArrow(bl.tidy(_members(bits, spark.sparkContext.broadcast(large))), bl.BLOCK_SCHEMA)
    joined = bl.regrouped(sets, total).mapInArrow(_regions(doc_bits), schema)
    joined = bl.cut(joined) if len(large[0]) else joined
    link = "v is not null and n is null"
    found = components(joined.where(link).union(both.where(link)).select("u", "v"))
    if len(large[0]):
        found = _second(spark, docs, joined, found, doc_bits, total)
    return census.where("df is null").select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates: of each component the document with the smallest doc_id.

    Rows that share a doc_id are judged each by its own text, after documents with an id of their
    own; of those with the same id and text one stays. Rows with a null doc_id stay.
    """

    def kept(rows, key):
        gone = groups(rows.select(F.col(key).alias("doc_id"), "text")).where("component_id <> doc_id")
        return rows.join(small_side(gone.select(F.col("doc_id").alias(key)).distinct()), key, "left_anti")  # beyond its limit a shuffle of the rows

    columns = [F.col(f"`{c}`") for c in docs.columns]
    shared = bl.cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if shared.isEmpty():
        return kept(docs, "doc_id").select(*columns)
    # a key for each (id, text) of the shared ids, above all ids
    key, hash_ = (next(n for n in (x + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns) for x in ("_key", "_hash"))
    text, top = F.coalesce(F.sha2(F.col("text").cast("string"), 256), F.lit("")), docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    again = docs.join(shared, "doc_id", "left_semi").withColumn(hash_, text).dropDuplicates(["doc_id", hash_])
    keys = bl.cut(again.select("doc_id", hash_).withColumn(key, F.lit(top) + 1 + F.monotonically_increasing_id()))
    rest = docs.join(shared, "doc_id", "left_anti").withColumn(key, F.col("doc_id").cast("long"))
    rows = bl.cut(again.join(keys, ["doc_id", hash_]).select(*columns, key).unionByName(rest.select(*columns, key)))
    return kept(rows, key).select(*columns)
