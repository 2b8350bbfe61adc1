from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from sparkreel.llm import nearest, queries


def brute(ids, v, k=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = nearest.exact(np.broadcast_to(v[i], v.shape), v)
        ok = np.flatnonzero(ids != ids[i])
        order = ok[np.lexsort((ids[ok], -s[ok]))][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def recall(got, want):
    hits = total = 0
    for q, best in want.items():
        mine = got.get(q, [])
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        hits += len({x for x, _ in best} & {x for _, x, _ in mine})
        total += len(best)
        assert all(abs(s - dict(best).get(x, s)) < 1e-12 for _, x, s in mine)
        order = [(-s, x) for _, x, s in mine]
        assert order == sorted(order)
    return hits / total


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_recall_on_table(spark):
    d = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    t = t[t.embedding.notna()]
    v = np.stack([np.asarray(x, np.float64) for x in t.embedding])
    ids = t.vec_id.to_numpy()
    got = collected(queries.op10_nearest(spark, d))
    assert recall(got, brute(ids, v)) >= 0.9
    assert all(len(x) == 20 for x in got.values())


def test_cases(spark):
    """Few rows, ties, copies of one vector beyond k, vectors that take no part."""
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(1, 50)]
    rows += [(1000 + k, [1.0] * 8) for k in range(100)] + [(0, [1.0] * 8), (20, [2.0] * 8)]
    rows = [r for r in rows if r[0] != 40]
    bad = [(60, None), (None, [1.0] * 8), (80, [0.0] * 8), (100, [float("nan")] * 8), (120, [float("inf")] + [0.0] * 7), (140, [None] + [1.0] * 7), (160, [])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows + bad], "vec_id long, embedding array<double>, bucket int").repartition(4)
    got = collected(nearest.nearest(df, projections=4, probes=81, width=100.0))  # one bucket: exact
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    want = brute(ids, v)
    got_pairs = {q: [x for _, x, _ in r] for q, r in got.items()}
    for q, best in want.items():
        seen = {}
        for x, s in best:
            seen.setdefault(x, s)
        assert got_pairs[q] == list(seen)[: len(got_pairs[q])]
    assert set(got) == set(want)
    assert nearest.nearest(df.limit(0)).count() == 0


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = collected(nearest.nearest(df))
    assert [x for _, x, _ in got[0]] == [1, 2]


def test_lengths_and_lonely_queries(spark):
    """A stray longer row removes nothing, and a query far from all buckets gets all candidates there are."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(60)]
    stray = [(900, rng.normal(size=17).tolist()), (901, rng.normal(size=17).tolist())]
    df = spark.createDataFrame(rows + stray, "vec_id long, embedding array<double>").repartition(3)
    got = collected(nearest.nearest(df, tables=1, width=0.2, probes=1))
    want = brute(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    assert recall(got, want) == 1 and set(got) == set(want) | {900}
    assert [x for _, x, _ in got[900]] == [901]


def test_uneven_norms(spark):
    """Rows of very different norms, one far longer than all: the largest inner products are found."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 24)) * rng.lognormal(0, 0.7, (3000, 1))
    v[77] *= 1000
    ids = np.arange(3000)
    got = collected(nearest.nearest(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)))
    assert recall(got, brute(ids, v)) >= 0.9


def test_share_falls_with_the_rows(spark):
    """What a query meets of all rows, next to recall, at growing sizes of vectors without structure."""
    rng, seen = np.random.default_rng(7), []
    for n in (2000, 8000, 32000):
        v = rng.normal(size=(n, 64))
        seen.append(nearest.shares(np.arange(n), v / np.linalg.norm(v, axis=1, keepdims=True), every=n // 40))
    assert all(r >= 0.9 for r, _, _ in seen)
    assert seen[0][1] > seen[1][1] > seen[2][1] and seen[2][1] < 0.65
    assert seen[0][2] > seen[1][2] > seen[2][2] and seen[1][2] < 1


def test_a_common_vector(spark):
    """A third of the rows are one vector; of its copies a batch sends as many as a ranking can use."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[::3] = v[0]
    ids = np.arange(900)
    keep = nearest.few_copies(ids, v, 20)
    assert keep.sum() == 600 + 21 and keep[:63:3].all()
    many = np.concatenate([np.ones(500, np.int64), ids])  # one id five hundred times
    keep = nearest.few_copies(many, np.concatenate([np.repeat(v[:1], 500, axis=0), v]), 20)
    assert keep.sum() == 600 + 21 and keep[:500].sum() == 1
    got = collected(nearest.nearest(spark.createDataFrame([(int(k), x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)))
    assert recall(got, brute(ids, v.astype(np.float64))) >= 0.9


def by_ids(ids, v, k=20, every=20):
    """Brute force over distinct ids: each with its best row."""
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = nearest.exact(np.broadcast_to(v[i], v.shape), v)
        found = {}
        for j in np.flatnonzero(ids != ids[i]):
            found[int(ids[j])] = max(s[j], found.get(int(ids[j]), -np.inf))
        mine = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
        out.setdefault(int(ids[i]), []).append(mine)
    return out


def test_repeated_ids(spark):
    """An id in many rows, of one vector or of several, takes one place; in buckets and in the exact way alike."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 8))
    rows = [(1, base[0])] * 30 + [(i, base[0]) for i in range(2, 12)] + [(20, base[0]), (20, base[0])]
    rows += [(50, base[1] * (1 + k / 50)) for k in range(60)] + [(100 + k, base[k]) for k in range(2, 40)] + [(60, base[1])]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in rows], "vec_id long, embedding array<double>")
    want = by_ids(ids, v)
    for parts in (1, 5):
        for given in ({"projections": 4, "probes": 81, "width": 100.0}, {"tables": 1, "width": 0.05, "probes": 1}):
            got = collected(nearest.nearest(df.repartition(parts), **given))
            assert set(got) == set(want)
            for q, (mine, *rest) in want.items():
                assert not [r for r in rest if r != mine] and [x for _, x, _ in got[q]] == [x for x, _ in mine]


def test_only_visited_buckets(monkeypatch):
    """Rows of buckets that a query does not visit are not compared with it."""
    rng = np.random.default_rng(13)
    v = rng.normal(size=(300, 8))
    key = np.arange(300, dtype=np.uint64) // np.uint64(50)
    q, vid, _ = nearest.search_part(np.array([1000]), rng.normal(size=(1, 8)), np.array([2]), np.array([3, 1], np.uint64), np.arange(300), v, key, 20)
    assert len(vid) == 20 and set(vid // 50) <= {1, 3} and set(q) == {1000}


def traced(work):
    """(result, peak MB of what it allocates)."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_bucket():
    """One bucket of many rows and queries is searched in little memory, also where all products tie, with the same results."""
    rng = np.random.default_rng(14)
    v, q = rng.normal(size=(20_000, 8)), rng.normal(size=(1000, 8))
    v[:, 0], q[500:, 1:] = 1, 0  # equal products of different rows
    ids, asks = rng.permutation(20_000), np.arange(100_000, 101_000)
    one = np.zeros(20_000, np.uint64)
    (qid, vid, score), peak = traced(lambda: nearest.search_part(asks, q, np.ones(1000, np.int64), np.zeros(1000, np.uint64), ids, v, one, 20))
    assert peak < 150
    assert len(qid) == 20_000
    for i in range(0, 1000, 37):
        s = nearest.exact(np.broadcast_to(q[i], v.shape), v)
        best = np.lexsort((ids, -s))[:20]
        mine = qid == asks[i]
        order = np.lexsort((vid[mine], -score[mine]))
        assert vid[mine][order].tolist() == ids[best].tolist() and score[mine][order].tolist() == s[best].tolist()


def test_what_is_sent_does_not_grow_with_the_probes():
    """A query goes once to each shard and takes the same bytes there, however many buckets it visits; a row goes to one shard."""
    rng = np.random.default_rng(15)
    v = rng.normal(size=(4000, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rb = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "vector"])
    for probes in (100, 10_000, 1_000_000):
        made = {32: nearest.Hashes(32, 1.0, 1, nearest.WIDTH, 1, 10, probes, 2)}
        counts = [(r["cell"], r["n"]) for b in nearest._cells(made)([rb]) for r in b.to_pylist()]
        where = {(32, 0): nearest.shards(counts, 0, 500)}
        (sent, peak) = traced(lambda: [r for b in nearest._send(made, where, 100, 20, 20)([rb]) for r in b.to_pylist()])
        assert peak < 60
        rows = [nearest._unpacked(r["block"]) for r in sent if not r["asks"]]
        asks = [(r["shard"], nearest._unpacked(r["block"])[0]) for r in sent if r["asks"]]
        assert sorted(np.concatenate([r[0] for r in rows]).tolist()) == list(range(4000)) and max(len(r[0]) for r in rows) <= 1000
        pairs = [(s, i) for s, ids in asks for i in ids.tolist()]
        assert len(pairs) == len(set(pairs)) and {i for _, i in pairs} == set(range(0, 4000, 20))
        assert sum(len(r["block"]) for r in sent if r["asks"]) < 400 * len(pairs)


def test_shards():
    """Neighbouring cells share a shard, a large cell has several; no shard takes far more than its share."""
    cells, first, parts = nearest.shards([(1, 40), (2, 60), (3, 30), (7, 1000), (8, 10), (9, 149)], 5, 100)
    assert cells.tolist() == [1, 2, 3, 7, 8, 9]
    assert first.tolist() == [5, 5, 6, 7, 17, 18] and parts.tolist() == [1, 1, 1, 10, 1, 1]


def test_a_large_cell_in_parts(spark, monkeypatch):
    """Shards of a few rows: cells cut by salt and whole searches in parts give what one shard gives."""
    rng = np.random.default_rng(16)
    v = np.concatenate([rng.normal(size=(600, 8)), 1 + 0.01 * rng.normal(size=(900, 8))])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    wide = collected(nearest.nearest(df, tables=2))
    monkeypatch.setattr(nearest, "SHARD_BYTES", 100 * 8 * 8)
    assert collected(nearest.nearest(df, tables=2)) == wide
    few = {"tables": 1, "width": 0.05, "probes": 1}
    assert collected(nearest.nearest(df, **few)) == {q: [(r + 1, x, s) for r, (x, s) in enumerate(b)] for q, b in brute(np.arange(1500), v).items()}
