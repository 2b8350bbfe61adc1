"""Product codes of vectors: a codebook for each part, by Lloyd's rounds with Elkan's pruning.

Vectors become integers, so every distance that decides is exact. A round keeps, for each part of
each vector, its entry, an upper bound of the distance to it and one lower bound of the distance to
each entry (Elkan, "Using the Triangle Inequality to Accelerate k-Means", 2003). When the entries
move, bounds move by as much, upper ones up and lower ones down. An entry is left out where the
upper bound is strictly below its lower bound, or strictly below half the way between it and
the vector's own entry: then it is strictly farther, and no tie is lost. What is left is measured,
first the own entry, which tightens the upper bound, then the rest; of equal squared distances the
lower index wins. Bounds are halves (16 bits), rounded outwards, so rounding prunes less and never wrongly.

Scale. One pass over the table makes blocks of up to BLOCK vectors: ids, labels, the integers and
the bounds, in Parquet in the shared folder. A round is one pass that reads blocks and writes blocks,
with each block's sums and counts by entry as a column of its own; the next codebook comes from
that column alone, added up by Spark, and is all that reaches the driver (parts x entries rows). Written
rounds survive lost executors; a round's blocks go when the next round's stand. No vector is shuffled.

Defined cases. Rows whose vector is null or empty, or holds null or non-finite components, take no part. Nor
do those whose length differs from that of the row with the smallest id, or can't be cut into equal parts
(all rows, if that one can't). Rows with one id are rows of their own, smaller vectors first; null ids come
last. With fewer rows than entries there are as many entries as rows. Integers beyond 2**27
in magnitude (components beyond 32,768) count as that, since sums of squares would leave a long. Rows with equal labels are
added up, null labels together. An empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import cut, shared_dir, small_side
from . import blocks as bl

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 4096
_MOST = 1 << 27


# -- bounds ---------------------------------------------------------------------------------------


def _up(x: np.ndarray) -> np.ndarray:
    """Halves not below x; what is too large becomes infinite."""
    with np.errstate(over="ignore"):
        h = x.astype(np.float16)
        low = h.astype(np.float64) < x
        h[low] = np.nextafter(h[low], np.float16(np.inf))
    return h


def _down(x: np.ndarray) -> np.ndarray:
    """Halves not above x, and not below 0."""
    h = np.clip(x, 0, 65504).astype(np.float16)
    high = h.astype(np.float64) > x
    h[high] = np.nextafter(h[high], np.float16(0))
    return np.maximum(h, np.float16(0))


def _root(square: np.ndarray) -> np.ndarray:
    """Square roots of exact integers; their error is far below a half's."""
    return np.sqrt(square.astype(np.float64))


_SLACK = 1e-9  # of a root or a sum in doubles, relative


def _more(x: np.ndarray) -> np.ndarray:
    return x * (1 + _SLACK)


def _less(x: np.ndarray) -> np.ndarray:
    return x * (1 - _SLACK)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class State:
    """Entry, upper bound and lower bounds for each part of each vector of a block."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.entry, self.upper, self.lower = entry, upper, lower

    @classmethod
    def new(cls, rows: int, parts: int, entries: int) -> State:
        """Bounds that know nothing."""
        return cls(np.zeros((rows, parts), np.uint8), np.full((rows, parts), np.inf, np.float16), np.zeros((rows, parts, entries), np.float16))

    def move(self, before: np.ndarray, after: np.ndarray) -> None:
        """Bounds hold again after the entries have moved."""
        way = _more(_root(squares(before, after)))  # parts x entries
        part = np.arange(way.shape[0])[None, :]
        self.upper = _up(_more(self.upper.astype(np.float64) + way[part, self.entry]))
        self.lower = _down(_less(self.lower.astype(np.float64)) - way[None])

    def assign(self, x: np.ndarray, book: np.ndarray) -> int:
        """Nearest entries of x (rows x parts x width); returns how many distances were measured."""
        apart = _less(_root(squares(book[:, :, None], book[:, None, :]))) / 2  # parts x entries x entries
        part = np.arange(x.shape[1])[None, :]
        every = np.arange(book.shape[1])

        def left(upper, r, p):
            """Entries that may be as near as the own one."""
            own = self.entry[r, p]
            u = upper[:, None].astype(np.float64)
            return ~((u < self.lower[r, p]) | (u < apart[p, own])) & (every != own[:, None])

        r, p = (np.ravel(a) for a in np.broadcast_arrays(np.arange(len(x))[:, None], part))
        some = left(self.upper[r, p], r, p).any(axis=1)
        r, p = r[some], p[some]
        own = self.entry[r, p]
        nearest = squares(x[r, p], book[p, own])
        measured = len(r)
        self.upper[r, p] = _up(_more(_root(nearest)))
        self.lower[r, p, own] = _down(_less(_root(nearest)))
        more = left(self.upper[r, p], r, p)
        found = np.full(more.shape, np.iinfo(np.int64).max)
        found[np.arange(len(r)), own] = nearest
        k, e = np.nonzero(more)
        d = squares(x[r[k], p[k]], book[p[k], e])
        measured += len(k)
        found[k, e] = d
        self.lower[r[k], p[k], e] = _down(_less(_root(d)))
        best = found.argmin(axis=1)  # the first, so the lowest index
        changed = best != own
        self.entry[r, p] = best
        self.upper[r[changed], p[changed]] = _up(_more(_root(found[changed, best[changed]])))
        return measured


def sums(x: np.ndarray, entry: np.ndarray, entries: int) -> np.ndarray:
    """Components' sums by part, entry and place, then counts by part and entry, in one row."""
    rows, parts, width = x.shape
    cell = (np.arange(parts)[None, :] * entries + entry).ravel()
    total = np.zeros((parts * entries, width), np.int64)
    np.add.at(total, cell, x.reshape(rows * parts, width))
    return np.concatenate([total.ravel(), np.bincount(cell, minlength=parts * entries)])


def moved(book: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The next codebook; entries without parts stay."""
    parts, entries, width = book.shape
    s, n = total[: book.size].reshape(book.shape), total[book.size :].reshape(parts, entries, 1)
    return np.where(n > 0, s // np.maximum(n, 1), book)


# -- passes -----------------------------------------------------------------------------------------


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact in doubles."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -_MOST, _MOST).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if not len(x) or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _good(vector: Column, length: int | None = None) -> Column:
    """Vectors whose components are all finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return finite & (F.size(vector) > 0 if length is None else F.size(vector) == length)


def _lists(flat: pa.Array, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), flat)


def _block(ids: pa.Array, labels: pa.Array, x: np.ndarray, state: State) -> pa.RecordBatch:
    body = bl.pack(_narrow(x.ravel()), state.entry.ravel(), state.upper.ravel(), state.lower.ravel())
    total = pa.array(sums(x, state.entry, state.lower.shape[2]), pa.int64())
    columns = [_lists(ids, len(ids)), _lists(labels, len(labels)), pa.array([body], pa.binary()), _lists(total, len(total))]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "body", "sums"])


def _unpacked(body: bytes, book: np.ndarray) -> tuple[np.ndarray, State]:
    x, entry, upper, lower = bl.unpack(body)
    parts, entries, width = book.shape
    return x.astype(np.int64).reshape(-1, parts, width), State(entry.reshape(-1, parts).copy(), upper.reshape(-1, parts).copy(), lower.reshape(-1, parts, entries).copy())


def _first(book: np.ndarray):
    """Blocks of rows, assigned to the first codebook."""

    def run(stream):
        parts, entries, width = book.shape
        for rb in stream:
            for a in range(0, rb.num_rows, BLOCK):
                part = rb.slice(a, BLOCK)
                x = integers(np.asarray(part.column(2).flatten())).reshape(-1, parts, width)
                state = State.new(len(x), parts, entries)
                state.assign(x, book)
                yield _block(part.column(0), part.column(1), x, state)
        bl.give_back()

    return run


def _next(before: np.ndarray, book: np.ndarray):
    """A round over blocks."""

    def run(stream):
        for rb in stream:
            for k in range(rb.num_rows):
                x, state = _unpacked(rb.column(2)[k].as_py(), book)
                state.move(before, book)
                state.assign(x, book)
                yield _block(rb.column(0).slice(k, 1).flatten(), rb.column(1).slice(k, 1).flatten(), x, state)
        bl.give_back()

    return run


def _last(before: np.ndarray, book: np.ndarray):
    """Ids, labels, codes and errors."""

    def run(stream):
        for rb in stream:
            for k in range(rb.num_rows):
                x, state = _unpacked(rb.column(2)[k].as_py(), book)
                state.move(before, book)
                state.assign(x, book)
                error = squares(x, book[np.arange(book.shape[0])[None, :], state.entry]).sum(axis=1)
                code = [bytes(row).hex() for row in state.entry]
                columns = [rb.column(0).slice(k, 1).flatten(), rb.column(1).slice(k, 1).flatten(), pa.array(code), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])
        bl.give_back()

    return run


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _total(written: DataFrame) -> np.ndarray:
    """All blocks' sums, added up by place."""
    rows = written.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()
    return np.array([r["n"] for r in rows], np.int64)


def train(spark: SparkSession, kept: DataFrame, book: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(blocks of the last round, the codebook they know, the codebook that follows)."""
    kinds = f"ids array<long>, labels array<{kept.schema['label'].dataType.simpleString()}>, body binary, sums array<long>"
    folder = f"{shared_dir(spark).rstrip('/')}/codes-{uuid.uuid4().hex}"
    work, source, before = _first(book), kept, book
    for k in range(rounds):
        source.mapInArrow(work, kinds).write.option("compression", "uncompressed").parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
        source = spark.read.schema(kinds).parquet(f"{folder}/{k}")
        before, book = book, moved(book, _total(source))
        work = _next(before, book)
    return source, before, book


def first_book(kept: DataFrame, entries: int, parts: int) -> np.ndarray | None:
    """Parts of the rows with the smallest ids; None without rows, or if vectors can't be cut so."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if not first or len(first[0]["vector"]) % parts:
        return None
    length = len(first[0]["vector"])
    rows = kept.where(F.size("vector") == length).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    x = integers(np.array([r["vector"] for r in rows], np.float64))
    return np.ascontiguousarray(x.reshape(len(rows), parts, length // parts).transpose(1, 0, 2))


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), the codebook as parts x entries x width). A code is two hex digits a part."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")).where(_good(F.col("vector")))
    book = first_book(kept, entries, parts)
    out = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    if book is None:
        return spark.createDataFrame([], out), np.zeros((parts, 0, 0), np.int64)
    kept = kept.where(_good(F.col("vector"), parts * book.shape[2]))
    written, before, book = train(spark, kept, book, rounds)
    return written.mapInArrow(_last(before, book), out), book


def checksum(book: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, in decimal with commas between."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that takes part."""
    coded, book = encode(vectors, **parameters)
    coded = cut(coded)
    by_label = small_side(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(checksum(book)).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL, with all distances of every round."""
    assign = """a{k} as (select vec_id, part, comps, entry, d from (select p.*, e.entry, list_sum(list_transform(list_zip(p.comps, e.comps), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d,
  row_number() over (partition by p.vec_id, p.part order by list_sum(list_transform(list_zip(p.comps, e.comps), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e.entry) as rk
  from parts p join e{k} e on p.part = e.part) where rk = 1)"""
    move = """e{n} as (select e.part, e.entry, coalesce(m.comps, e.comps) as comps from e{k} e left join
  (select part, entry, list(c order by spot) as comps from (select part, entry, spot, floor(sum(c)::hugeint::double / count(*))::bigint as c
    from (select part, entry, unnest(comps) as c, unnest(range(len(comps))) as spot from a{k}) group by part, entry, spot) group by part, entry) m
  on e.part = m.part and e.entry = m.entry)"""
    steps = [s for k in range(rounds) for s in (assign.format(k=k), move.format(k=k, n=k + 1))] + [assign.format(k=rounds)]
    return f"""with kept as (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select vec_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] as comps from kept, range({parts}) r(part)),
seeds as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {entries}),
e0 as (select part, entry, comps from parts join seeds using (vec_id)),
{", ".join(steps)},
coded as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by vec_id),
book as (select sha256(string_agg(array_to_string(comps, ','), ',' order by part, entry)) as sha from e{rounds})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, sha as codebooks_sha256 from coded join kept using (vec_id), book"""


ORACLE = _oracle()
