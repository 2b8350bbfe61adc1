"""Approximate nearest neighbours by multiprobe p-stable hashing.

Inner products become distances by one more dimension: a row x is hashed as (x / M, sqrt(1 - |x / M|^2))
and a query q as (q / |q|, 0), so their squared distance is 2 - 2 q.x / (|q| M) and the nearest row has
the largest inner product. M is the NORM quantile of the rows' norms, so that one long row does not
press all others together; longer rows are hashed by their direction.

Each of TABLES tables cuts random normal projections into cells of WIDTH; the cells together are a
bucket. A query visits, in every table, the buckets of the highest estimated chance to hold a
neighbour: those with the least sums of squared distances to the cell borders that must be crossed (Lv,
Josephson, Wang, Charikar, Li, "Multi-Probe LSH", 2007), rounded up to 1 / FINE; up to a sum at which `probes`
buckets are visited on average. Candidates of all tables are ranked by their exact inner product in double precision.

Parameters follow the number n of rows of a length: 10 projections and 0.45 log2(n / 1e6) more beyond a million rows,
as smaller buckets would cost more by themselves than the products that they save; probes fall as n ** -0.23, since the nearest rows come
closer, and grow by 1.9 with each projection, since the borders to cross grow with them; most of them are empty. One table with many probes costs
fewer inner products than four with few and moves each row once. Rows that
stand in no bucket that a query visits are never compared with it. What a query meets of all rows, how
many inner products that costs, and recall: see `shares` and the README.

Scale. The first projections make a coarse cell. The rows of each coarse cell are counted, and neighbouring
cells are put together, or a large one is cut by salt, into shards of about equal numbers of rows, of
half as much again as SHARD_BYTES at most. A row goes to the shard of its cell, and a query once to each shard with a cell that it may visit: not with
its probes, whose number grows with the table, but with its cell, what each border costs and how far it reaches;
by these the shard tells which of the buckets that it has are visited. A task holds the rows of one shard and a
piece of the queries, and prunes what it has found whenever that is more than HELD times k for each query, so its memory does not
depend on the number of rows or queries. Of the copies of a vector only one row of each of the k + 1
smallest ids of a batch goes on, as no ranking can use more, so a very common vector costs k + 1 rows a batch.
A shard keeps the k best of each query before anything leaves it.

Every row is indexed and every query row is searched. Queries for which the tables find fewer than
k are searched exactly, in blocks against all rows, so they get all candidates there are, up to k.

Defined cases: a row whose id or vector is null, or whose vector is empty, zero or holds
null or non-finite numbers takes no part. Vectors of one length are each other's
candidates; every length has buckets of its own. Rows with the id of the query are not its
candidates. Several candidates of one id count once, with the best score. Ties go to the
smaller id. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import textkit as tk

TABLES, WIDTH, NORM = 1, 1.8, 0.999
PROBES = 145_000
#: Cells of a projection that a query may visit besides its own.
STEPS = (-1, 1, -2, 2)
#: Bytes of a shard's vectors in double precision, and shards that even a small table has, if that leaves SHARD_ROWS a shard.
SHARD_BYTES, SHARDS, SHARD_ROWS = 16 << 20, 24, 1000
#: Rows of a bucket multiplied at once, pairs of a bucket and a query looked at once, candidates held for a query as a multiple of k.
BUCKET_ROWS, PAIRS, HELD = 256, 8 << 20, 16
#: Numbers of a batch's vectors handled at once.
SLICE = 1 << 20
#: Steps of a cell's width squared, in which costs are counted, and what cells cost that none visits.
FINE, FAR = 256, 20_000
#: Lengths of vectors that have tables; queries of rarer lengths are searched exactly.
LENGTHS = 1000
OUT = "query_id long, rank int, vec_id long, score double"
SENT = "shard int, bucket long, asks boolean, block binary"
_SENT = pa.schema([("shard", pa.int32()), ("bucket", pa.int64()), ("asks", pa.bool_()), ("block", pa.binary())])


def fitting(n: int) -> dict:
    """projections, probes and coarse (projections of the coarse cell) for n rows."""
    n = max(n, 100)
    k = 10 + max(0, round(0.45 * math.log2(n / 1e6)))
    return {"projections": k, "probes": round(PROBES * (n / 2000) ** -0.23 * 1.9 ** (k - 10)), "coarse": min(k, 6, max(2, round(0.5 * math.log2(n / 2000))))}


class Hashes:
    """The tables for vectors of one length."""

    def __init__(self, dim: int, norm: float, tables: int, width: float, seed: int, projections: int, probes: int, coarse: int):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.norm, self.tables, self.k, self.width, self.coarse = dim, norm, tables, projections, width, coarse
        self.a = rng.normal(size=(tables, dim + 1, projections))
        self.b = rng.uniform(0, width, (tables, projections))
        self.reach = self._reach(probes)

    def completed(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors whose distances follow the inner products."""
        size = np.linalg.norm(v, axis=1, keepdims=True)
        part = v / (size if query else np.maximum(size, self.norm))
        rest = 1 - np.minimum(size / (size if query else self.norm), 1) ** 2
        return np.concatenate([part, np.sqrt(rest)], axis=1)

    def place(self, v: np.ndarray, table: int) -> np.ndarray:
        """Coordinates of completed vectors, whose floor is the cell."""
        return (v @ self.a[table] + self.b[table]) / self.width

    def cells(self, v: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each completed vector: a cell of every projection."""
        return np.clip(np.floor(self.place(v, table)), -32_000, 32_000).astype(np.int16)

    def asked(self, q: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, costs of the cells at STEPS from them in each projection, reach) of completed queries."""
        at = self.place(q, table)
        into = (at - np.floor(at))[:, :, None]
        cost = np.maximum(1, np.ceil(FINE * np.concatenate([into, 1 - into, 1 + into, 2 - into], axis=2) ** 2)).astype(np.uint16)
        return self.cells(q, table), cost, np.full(len(q), self.reach, np.uint16)

    def _reach(self, count: int) -> int:
        """The highest sum of costs at which a query visits `count` buckets on average, wherever it stands in its cell."""
        into = (np.arange(1000) + 0.5)[:, None] / 1000
        one = np.bincount(np.ceil(FINE * np.concatenate([into, 1 - into, 1 + into, 2 - into], axis=1) ** 2).astype(np.int64).ravel()) / 1000
        one[0] = 1
        sums = np.ones(1)
        for _ in range(self.k):
            sums = np.convolve(sums, one)
        return min(FAR - 1, max(0, int(np.searchsorted(np.cumsum(sums), count * (1 + 1e-9), "right")) - 1))

    def coarse_cell(self, cells: np.ndarray) -> np.ndarray:
        """The coarse cell as one integer, in the order of cells."""
        key = np.zeros(len(cells), np.int64)
        for j in range(self.coarse):
            key = (key << 10) + np.clip(cells[:, j].astype(np.int64) + 512, 0, 1023)
        return key

    def coarse_ways(self, cells: np.ndarray, cost: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, coarse cell) of the coarse cells with buckets within reach."""
        key, sum_ = self.coarse_cell(cells)[:, None], np.zeros((len(cells), 1), np.int64)
        for j in range(self.coarse):
            step = 1 << 10 * (self.coarse - 1 - j)
            ways = np.stack([np.zeros(len(cells), np.int64), *cost[:, j].astype(np.int64).T], axis=1)
            key = (key[:, :, None] + step * np.array([0, *STEPS])).reshape(len(cells), -1)
            sum_ = (sum_[:, :, None] + ways[:, None, :]).reshape(len(cells), -1)
        who, way = np.nonzero(sum_ <= reach[:, None])
        return who, key[who, way]


def shards(counts: list[tuple[int, int]], at: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coarse cells, the first shard of each, its shards) for (cell, rows) in the order of cells; shards from `at` on take
    about `rows` each: small neighbours share one, a large cell has several."""
    first, parts, held = [], [], 0
    for _, n in counts:
        many = max(1, round(n / rows))
        if held and (many > 1 or held + n > 1.25 * rows):
            at, held = at + 1, 0
        first.append(at)
        parts.append(many)
        at, held = (at + many, 0) if many > 1 else (at, held + n)
    return np.array([c for c, _ in counts], np.int64), np.array(first, np.int64), np.array(parts, np.int64)


def vector_hashes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bits in double precision) of vectors."""
    bits = np.ascontiguousarray(v.astype(np.float64)).view(np.uint64).reshape(len(v), -1)
    dim = bits.shape[1]
    step = max(1, SLICE // dim)
    return np.concatenate([np.zeros(0, np.uint64), *(tk.window_hashes(bits[a : a + step].ravel(), dim)[::dim] for a in range(0, len(bits), step))]), bits


def few_copies(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Which rows a ranking can use: of each vector one row for each of its k + 1 smallest ids."""
    h, bits = vector_hashes(v)
    by = np.lexsort((ids, h))
    h, i, bits = h[by], ids[by], bits[by]
    new = np.append(True, h[1:] != h[:-1])
    other = new | np.append(True, i[1:] != i[:-1])  # the first row of an id among its hash
    start = np.flatnonzero(new)
    lead = np.repeat(start, np.diff(np.append(start, len(h))))
    nth = np.cumsum(other)
    nth -= nth[lead]
    keep = np.empty(len(h), bool)
    keep[by] = (other & (nth <= k)) | (bits != bits[lead]).any(axis=1)  # another vector of the same hash stays
    return keep


def lengths(rb: pa.RecordBatch) -> list[int]:
    """Lengths of a batch's vectors."""
    return sorted(x for x in pc.unique(pc.list_value_length(rb.column(1))).to_pylist() if x)


def usable(rb: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors as they are stored) of the rows of this length that take part."""
    ids, vec = rb.column(0), rb.column(1)
    size = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False)
    ok = (size == dim) & ids.is_valid().to_numpy(zero_copy_only=False)
    take = pa.array(np.flatnonzero(ok))
    flat = pc.list_flatten(vec.take(take))
    kind = pa.float32() if pa.types.is_float32(flat.type) else pa.float64()
    v = flat.cast(kind).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
    return ids.take(take).to_numpy(zero_copy_only=False)[good], v[good]


def _slices(stream):
    """(length, ids, vectors) of the rows that take part, some MB at once."""
    for rb in stream:
        for dim in lengths(rb):
            step = max(1, SLICE // dim)
            for a in range(0, len(rb), step):
                ids, v = usable(rb.slice(a, step), dim)
                if len(ids):
                    yield dim, ids, v


def _norms(stream):
    """(length, norm) of the rows that take part."""
    for dim, _, v in _slices(stream):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), dim, np.int32)), pa.array(np.linalg.norm(v.astype(np.float64), axis=1))], names=["length", "norm"])


def _cells(made: dict[int, Hashes]):
    """(length, tab, cell, n): rows of each coarse cell in a slice."""

    def run(stream):
        for dim, _, v in _slices(stream):
            if dim in made:
                full = made[dim].completed(v.astype(np.float64), False)
                for t in range(made[dim].tables):
                    cell, n = np.unique(made[dim].coarse_cell(made[dim].cells(full, t)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), dim, np.int32)), pa.array(np.full(len(n), t, np.int32)), pa.array(cell), pa.array(n.astype(np.int64))], names=["length", "tab", "cell", "n"])

    return run


def _packed(ids, v, rows, *more) -> bytes:
    """Rows (ids, vectors, cells) or queries (ids, vectors, cells, costs, reach)."""
    bits = np.ascontiguousarray(v[rows]).reshape(-1)
    return bl.pack(ids[rows], bits.view(np.uint32 if bits.itemsize == 4 else np.uint64), *(x.reshape(-1) for x in more))


def _unpacked(block: bytes) -> list[np.ndarray]:
    """The same, vectors in double precision and a row for each id."""
    ids, bits, *more = bl.unpack(block)
    v = bits.view(np.float32 if bits.itemsize == 4 else np.float64).reshape(len(ids), -1).astype(np.float64)
    return [ids, v, *(x.reshape(len(ids), -1) for x in more)]


def _groups(key: np.ndarray):
    """(key, places) of equal keys."""
    order = np.argsort(key, kind="stable")
    for x, places in _runs(key[order]):
        yield int(x), order[places]


def _sent(rows, limit: int = 4 << 20):
    """Batches of a few MB of (shard, bucket, asks, block)."""

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(_SENT)], schema=_SENT)

    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if size >= limit:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
    bl.give_back()


def _salt(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tk.mix(ids.astype(np.int64).view(np.uint64) ^ vector_hashes(v)[0], 9)


def _send(made: dict[int, Hashes], where: dict[tuple[int, int], tuple], wide: int, every: int, k: int):
    """Rows to the shard of their coarse cell, and queries to each shard with a coarse cell in reach."""

    def sent(stream):
        for dim, ids, v in _slices(stream):
            if dim not in made:
                continue
            hashes, use = made[dim], np.flatnonzero(few_copies(ids, v, k))
            full, salt = hashes.completed(v[use].astype(np.float64), False), _salt(ids[use], v[use])
            asks = np.flatnonzero(ids % every == 0)
            ask = hashes.completed(v[asks].astype(np.float64), True)
            for t in range(hashes.tables):
                known, first, parts = where[dim, t]
                cells = hashes.cells(full, t)
                at = np.minimum(np.searchsorted(known, hashes.coarse_cell(cells)), len(known) - 1)
                for to, rows in _groups(first[at] + (salt % parts[at].astype(np.uint64)).astype(np.int64)):
                    yield to % wide, to, False, _packed(ids, v, use[rows], cells[rows])
                step = max(1, SLICE // (1 + len(STEPS)) ** hashes.coarse)
                for a in range(0, len(asks), step):
                    own = hashes.asked(ask[a : a + step], t)
                    who, cell = hashes.coarse_ways(*own)
                    at = np.minimum(np.searchsorted(known, cell), len(known) - 1)
                    who, at = who[known[at] == cell], at[known[at] == cell]
                    to, which = tk.expand(first[at], parts[at])
                    pairs = np.unique(to * step + who[which])
                    for x, places in _runs(pairs // step):
                        mine = pairs[places] % step
                        yield int(x) % wide, int(x), True, _packed(ids, v, asks[a + mine], *(x[mine] for x in own))

    return lambda stream: _sent(sent(stream))


def _send_whole(parts: dict[int, int], wide: int, k: int, asking: bool):
    """All rows by part, or queries to all parts; `parts` has the parts of each length. A part is one bucket."""

    def sent(stream):
        for dim, ids, v in _slices(stream):
            n = parts.get(dim, 1)
            if asking:
                for p in range(n):
                    none = np.zeros((len(ids), 0), np.int16)
                    yield (dim + p) % wide, (dim << 32) + p, True, _packed(ids, v, np.arange(len(ids)), none, none.astype(np.uint16), np.zeros(len(ids), np.uint16))
            else:
                use = np.flatnonzero(few_copies(ids, v, k))
                for p, rows in _groups((_salt(ids[use], v[use]) % np.uint64(n)).astype(np.int64)):
                    yield (dim + p) % wide, (dim << 32) + p, False, _packed(ids, v, use[rows], np.zeros((len(rows), 0), np.int16))

    return lambda stream: _sent(sent(stream))


def chosen(qid, vid, score, k):
    """(places, ranks from 0) of each query's k best, one row for each id."""
    order = np.lexsort((-score, vid, qid))
    new = np.append(True, (qid[order][1:] != qid[order][:-1]) | (vid[order][1:] != vid[order][:-1])) if len(qid) else np.zeros(0, bool)
    order = order[new]
    order = order[np.lexsort((vid[order], -score[order], qid[order]))]
    q = qid[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k], rank[rank < k]


def best(qid, vid, score, k):
    """Of each query the k best, one row for each id."""
    at, rank = chosen(qid, vid, score, k)
    return qid[at], rank + 1, vid[at], score[at]


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one fixed order, so that equal vectors tie exactly."""
    return np.add.reduce(q * v, axis=1)


def kth(who: np.ndarray, vid: np.ndarray, g: np.ndarray, queries: int, k: int) -> np.ndarray:
    """The k-th best product of each query, an id counted once; -inf with fewer ids. A little less, as rounding may change places."""
    order = np.argsort(-g)
    order = order[np.argsort(vid[order], kind="stable")]
    order = order[np.argsort(who[order].astype(np.min_scalar_type(queries)), kind="stable")]
    first = np.append(True, (who[order][1:] != who[order][:-1]) | (vid[order][1:] != vid[order][:-1])) if len(who) else np.zeros(0, bool)
    return _kth(who[order[first]], g[order[first]], queries, k)


def _kth(who: np.ndarray, g: np.ndarray, queries: int, k: int) -> np.ndarray:
    """The same of different ids."""
    order = np.argsort(-g)
    order = order[np.argsort(who[order].astype(np.min_scalar_type(queries)), kind="stable")]
    who, g = who[order], g[order]
    at = np.searchsorted(who, np.arange(queries)) + k - 1
    ok = np.flatnonzero(at < len(who))
    ok = ok[who[at[ok]] == ok]
    out = np.full(queries, -np.inf)
    out[ok] = g[at[ok]] - 1e-9 * np.maximum(1, np.abs(g[at[ok]]))
    return out


class Shelf:
    """A shard's rows by bucket, in runs of BUCKET_ROWS at most."""

    def __init__(self, vid: np.ndarray, v: np.ndarray, key: np.ndarray, k: int):
        keep = few_copies(vid, v, k)
        rows = np.flatnonzero(keep)[np.argsort(key[keep], kind="stable")]
        self.k, self.rows, self.vid, self.v = k, rows, vid[rows], v[rows]
        key = key[rows]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        self.key = key[start]
        self.runs = -(-size // BUCKET_ROWS)
        self.first = np.cumsum(self.runs) - self.runs
        at, which = tk.expand(np.zeros(len(start), np.int64), self.runs)
        self.start = start[which] + at * BUCKET_ROWS
        self.end = np.minimum(self.start + BUCKET_ROWS, (start + size)[which])
        self.piece = max(64, min(4096, PAIRS // max(1, len(start)), 4 * SLICE // v.shape[1]))  # queries at once
        self.alone = len(np.unique(self.vid)) == len(self.vid)

    def search(self, qid: np.ndarray, q: np.ndarray, who: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query, for pairs of a query's place and the place of a bucket it visits, by bucket.

        Whenever more is held than HELD * k a query, the k-th best so far becomes a bound, and only what reaches it is kept;
        if ties keep that from helping, the k best by exact products and ids."""
        bound, found, held = np.full(len(qid), -np.inf), [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))], 0
        full = max(1 << 16, HELD * self.k * len(qid))
        for b, places in _runs(at):
            mine = who[places]
            mq = q[mine]
            for run in range(self.first[b], self.first[b] + self.runs[b]):
                a, z = self.start[run], self.end[run]
                g = mq @ self.v[a:z].T
                at_ = np.flatnonzero(g >= bound[mine, None])
                if not len(at_):
                    continue
                r, c = np.divmod(at_, z - a)
                i, j = mine[r], a + c
                other = qid[i] != self.vid[j]
                found.append((i[other].astype(np.int32), j[other].astype(np.int32), g.ravel()[at_[other]]))
                held += len(found[-1][0])
                if held > full:
                    i, j, g, bound = self._pruned(found, len(qid))
                    if 2 * len(i) > full:
                        keep, _ = chosen(i, self.vid[j], self._exact(q, i, j), self.k)
                        i, j, g = i[keep], j[keep], g[keep]
                    found, held = [(i, j, g)], len(i)
        i, j, _, _ = self._pruned(found, len(qid))
        # what is left, with what rounding may bring to a place, is ranked exactly
        qid, _, vid, score = best(qid[i], self.vid[j], self._exact(q, i, j), self.k)
        return qid, vid, score

    def _exact(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = max(1, SLICE // q.shape[1])
        return np.concatenate([np.zeros(0), *(exact(q[i[a : a + step]], self.v[j[a : a + step]]) for a in range(0, len(i), step))])

    def _pruned(self, found: list, queries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, j, g = (np.concatenate(x) for x in zip(*found, strict=True))
        bound = _kth(i, g, queries, self.k) if self.alone else kth(i, self.vid[j], g, queries, self.k)
        keep = g >= bound[i]
        return i[keep], j[keep], g[keep], bound


def search_part(qid, q, n_probes, probes, vid, v, key, k):
    """The k best of each query among the rows of the buckets it visits (equal keys)."""
    shelf = Shelf(vid, v, key, k)
    at = np.minimum(np.searchsorted(shelf.key, probes), len(shelf.key) - 1)
    hit = np.flatnonzero(shelf.key[at] == probes)
    hit = hit[np.argsort(at[hit], kind="stable")]
    return shelf.search(qid, q, np.repeat(np.arange(len(qid)), n_probes)[hit], at[hit])


def _runs(a: np.ndarray):
    """(value, slice) of the runs of equal values."""
    cut = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    for x, y in zip(cut.tolist(), np.append(cut[1:], len(a)).tolist(), strict=False):
        yield a[x], slice(x, y)


class Visits:
    """Which buckets queries visit. The costs of the two halves of a bucket's cells are summed up once for all buckets that share them."""

    def __init__(self, cells: np.ndarray):
        half = cells.shape[1] // 2
        self.halves = [(slice(a, b), *self._different(cells[:, a:b])) for a, b in ((0, half), (half, cells.shape[1]))]

    @staticmethod
    def numbers(cells: np.ndarray) -> np.ndarray:
        """A hash of the cells of each row."""
        h = np.zeros(len(cells), np.uint64)
        for j in range(cells.shape[1]):
            h = tk.mix(h + cells[:, j].astype(np.int64).view(np.uint64), j)
        return h

    def _different(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, back = np.unique(self.numbers(cells), return_index=True, return_inverse=True)
        return cells[first], back

    def pairs(self, cells: np.ndarray, cost: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the buckets, places of the queries), by bucket."""
        total, cost = None, cost.reshape(len(cells), cells.shape[1], len(STEPS))
        for own, different, back in self.halves:
            sums = np.zeros((len(different), len(cells)), np.uint16)
            for j, c in enumerate(different.T, own.start):
                known, at = np.unique(c, return_inverse=True)
                d = known[:, None].astype(np.int32) - cells[None, :, j]
                step = np.select([d == 0, *(d == x for x in STEPS)], [np.uint16(0), *cost[:, j, :].T], np.uint16(FAR))
                sums = np.minimum(sums + step[at], np.uint16(FAR))
            total = sums[back] if total is None else total + sums[back]
        return np.nonzero(total <= reach[None, :])


def _search(k, query_bits):
    """Of each bucket's rows, which come before its queries, the k best of each query; pieces of queries at once."""

    def ask(shelf, visits, held):
        qid, q, cells, cost, reach = (np.concatenate(x) for x in zip(*held, strict=True))
        for a in range(0, len(qid), shelf.piece):
            z = slice(a, a + shelf.piece)
            at, who = visits.pairs(cells[z], cost[z], reach[z, 0])
            found, vid, score = shelf.search(qid[z], q[z], who, at)
            if len(found):
                yield from bl.to_documents(found, query_bits, vid, score)

    def each(stream):
        now, rows, held, n, shelf, visits = None, [], [], 0, None, None
        for rb in stream:
            blocks = rb.column(3)
            for i, (bucket, asks) in enumerate(zip(rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True)):
                if bucket != now:
                    if held:
                        yield from ask(shelf, visits, held)
                    now, rows, held, n, shelf, visits = bucket, [], [], 0, None, None
                if not asks:
                    rows.append(_unpacked(blocks[i].as_py()))
                    continue
                if rows:
                    vid, v, cells = (np.concatenate(x) for x in zip(*rows, strict=True))
                    rows = []
                    shelf = Shelf(vid, v, Visits.numbers(cells), k)
                    starts = shelf.start[shelf.first]
                    visits = Visits(cells[shelf.rows[starts]])
                    vid = v = cells = None
                if shelf is not None:
                    held.append(_unpacked(blocks[i].as_py()))
                    n += len(held[-1][0])
                    if n >= shelf.piece:
                        yield from ask(shelf, visits, held)
                        held, n = [], 0
        if held:
            yield from ask(shelf, visits, held)
        rows = held = shelf = visits = None
        bl.give_back()

    return lambda stream: bl.batches(each(stream))


def _rank(k):
    """The k best of each query; what a bucket of queries holds is cut to them whenever it is over SLICE candidates."""

    def ranked(held):
        q, r, v, s = best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(r.astype(np.int32)), pa.array(v), pa.array(s)], names=["query_id", "rank", "vec_id", "score"])

    def run(stream):
        now, held, n = None, [], 0
        for rb in stream:
            for bucket, block in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                if bucket != now:
                    if held:
                        yield ranked(held)
                    now, held, n = bucket, [], 0
                held.append(bl.unpack(block.as_py()))
                n += len(held[-1][0])
                if n > SLICE:
                    q, _, v, s = best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
                    held, n = [(q, v, s)], 0
        if held:
            yield ranked(held)
        held = []
        bl.give_back()

    return run


def nearest(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, tables: int = TABLES, projections: int | None = None, width: float = WIDTH, probes: int | None = None, seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k nearest found."""
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"))
    sizes = rows.mapInArrow(_norms, "length int, norm double").groupBy("length").agg(F.count("*").alias("n"), F.percentile_approx("norm", NORM, 10_000).alias("norm"))
    found = sizes.orderBy(F.desc("n"), "length").limit(LENGTHS).collect()
    n, query_bits = sum(r["n"] for r in found), bl.bits_for(sum(r["n"] for r in found) / every, 2000)
    given = {name: x for name, x in (("projections", projections), ("probes", probes)) if x is not None}
    made, counted = {}, {}
    for r in found:
        fit = fitting(r["n"]) | given
        made[r["length"]] = Hashes(r["length"], r["norm"], tables, width, seed, **fit | {"coarse": min(fit["coarse"], fit["projections"])})
    for dim, t, cell, size in sorted(rows.mapInArrow(_cells(made), "length int, tab int, cell long, n long").groupBy("length", "tab", "cell").agg(F.sum("n")).collect()):
        counted.setdefault((dim, t), []).append((cell, size))
    where, total, parts = {}, 0, {}
    for (dim, t), counts in counted.items():
        size = sum(c for _, c in counts)
        most = max(1, SHARD_BYTES // (8 * dim))
        parts[dim] = max(-(-size // most), min(SHARDS, -(-size // SHARD_ROWS)))
        where[dim, t] = shards(counts, total, max(1, -(-size // parts[dim])))
        total = int((where[dim, t][1] + where[dim, t][2]).max())

    # rare lengths share partitions
    wide = max(1, min(total, 4 * max(SHARDS, sum(r["n"] * 8 * r["length"] for r in found) * tables // SHARD_BYTES)))

    def ranked(sent):
        near = sent.repartitionById(wide, "shard").sortWithinPartitions("bucket", "asks")
        return bl.regrouped(near.mapInArrow(_search(k, query_bits), bl.BLOCK_SCHEMA)).mapInArrow(_rank(k), OUT)

    first = bl.cut(ranked(rows.mapInArrow(_send(made, where, wide, every, k), SENT)))
    full = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    finite = "not exists(vector, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(vector, x -> x <> 0)"
    short = rows.where((F.col("id") % every == 0) & F.expr(finite)).join(full, "id", "left_anti")
    if not n or not short.limit(1).count():
        return first
    whole = rows.mapInArrow(_send_whole(parts, wide, k, False), SENT).unionByName(short.select("id", "vector").mapInArrow(_send_whole(parts, wide, k, True), SENT))
    return first.join(full.select(F.col("id").alias("query_id")), "query_id", "left_semi").unionByName(ranked(whole))


def shares(ids: np.ndarray, v: np.ndarray, k: int = 20, every: int = 20, seed: int = 1, **given) -> tuple[float, float, float]:
    """(recall, share of all rows that a query meets, inner products a query as a share of brute force's) of the parameters for these rows: for samples."""
    v = np.asarray(v, np.float64)
    hashes = Hashes(v.shape[1], float(np.quantile(np.linalg.norm(v, axis=1), NORM)), TABLES, WIDTH, seed, **fitting(len(v)) | given)
    asks = np.flatnonzero(ids % every == 0)
    met, products = np.zeros((len(asks), len(v)), bool), 0
    for t in range(hashes.tables):
        visits = Visits(hashes.cells(hashes.completed(v, False), t))
        for a in range(0, len(asks), 64):
            rows, who = visits.pairs(*hashes.asked(hashes.completed(v[asks[a : a + 64]], True), t))
            met[a + who, rows] = True
            products += len(who)
    scores = v[asks] @ v.T
    scores[ids[asks][:, None] == ids[None, :]] = -np.inf
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return float(np.take_along_axis(met, top, 1).mean()), float(met.mean()), products / met.size
