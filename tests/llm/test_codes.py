from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkreel.llm import codes, queries

SCHEMA = "vec_id long, embedding array<float>, label string, entry int, `a.b` int, body string"


def brute(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds with every distance, in Python integers. Rows: (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept or len(kept[0][1]) % parts:
        return []
    n = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == n]
    width = n // parts
    cut = [[[math.floor(4096 * float(np.float32(x))) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in kept]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for x in cut:
                groups[nearest(x[p], books[p])[1]].append(x[p])
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g)]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    errors, by_label = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for r, e in zip(kept, errors):
        by_label[r[2]] += e
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], sha) for r, f, e in zip(kept, found, errors)), key=repr)


def found(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(parts)


def vectors(seed, n, dims=16, steps=None):
    rng = random.Random(seed)
    value = (lambda: rng.gauss(0, 0.2)) if steps is None else (lambda: rng.randrange(-steps, steps + 1) / 4096)
    return [(k * 3, [float(np.float32(value())) for _ in range(dims)], rng.choice(["a", "b", None])) for k in range(n)]


@pytest.mark.parametrize("steps", [None, 1, 3])
def test_small_tables(spark, steps):
    """Few different components make ties everywhere."""
    rows = vectors(1, 150, steps=steps)
    assert found(codes.report(frame(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    rows = vectors(2, 60)
    rows += [(1, None, "a"), (2, [], "a"), (4, [None] * 16, "a"), (5, [float("nan")] + [0.0] * 15, None), (7, [float("inf")] * 16, "b"), (8, [0.1] * 24, "a"), (None, [0.25] * 16, "c")]
    rows += [rows[3], rows[3], (rows[3][0], [0.5] * 16, "a"), (10, [-0.0] * 16, "b"), (11, [0.0] * 16, "b")] + [(500 + k, rows[5][1], "hot") for k in range(80)]
    random.Random(1).shuffle(rows)
    assert found(codes.report(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17])
def test_few_rows(spark, n):
    rows = vectors(3, n)
    assert found(codes.report(frame(spark, rows))) == brute(rows)


def test_lengths_that_cannot_be_cut(spark):
    assert found(codes.report(frame(spark, [(1, [0.5] * 12, "a"), (2, [0.5] * 16, "a")]))) == []


def test_other_parameters(spark):
    rows = vectors(4, 90, dims=12)
    coded, book = codes.encode(frame(spark, rows), parts=4, entries=5, rounds=3)
    want = brute(rows, 4, 5, 3)
    assert sorted(((r.vec_id, r.code, r.error) for r in coded.collect()), key=repr) == [w[:3] for w in want]
    assert codes.checksum(book) == want[0][-1]


@given(st.lists(st.floats(0, 1e12), min_size=1, max_size=50))
@settings(max_examples=300, deadline=None)
def test_bounds_round_outwards(values):
    x = np.array(values)
    assert (codes._up(x).astype(np.float64) >= x).all() and (codes._down(x).astype(np.float64) <= x).all()


@pytest.mark.parametrize("seed", range(20))
def test_bounds_hold_and_prune(seed):
    """After each round bounds enclose the true distances, entries are those of a full search, and fewer distances are measured."""
    rng = np.random.default_rng(seed)
    scale = (2, 400, 1 << 27)[seed % 3]
    centres = rng.integers(-scale, scale + 1, (6, 3, 4))
    x = np.clip(centres[rng.integers(0, 6, 400)] + rng.integers(-max(1, scale // 9), max(2, scale // 9), (400, 3, 4)), -(1 << 27), 1 << 27)
    book = np.ascontiguousarray(x[:7].transpose(1, 0, 2))
    state, measured = codes.State.new(400, 3, 7), []
    for _ in range(8):
        measured.append(state.assign(x, book))
        d = codes.squares(x[:, :, None, :], book[None])
        assert (state.entry == d.argmin(axis=2)).all()
        true = np.sqrt(d.astype(np.float64))
        assert (state.lower <= true * (1 + 1e-12)).all()
        assert (state.upper >= np.take_along_axis(true, state.entry[:, :, None].astype(int), 2)[:, :, 0] * (1 - 1e-12)).all()
        total = codes.sums(x, state.entry, 7)
        after = codes.moved(book, total)
        state.move(book, after)
        book = after
    if scale == 400:
        assert measured[-1] < measured[0] / 3


def test_sums_of_blocks_are_the_sums_of_rows():
    x = np.arange(2 * 3 * 4).reshape(2, 3, 4)
    entry = np.array([[0, 1, 1], [0, 0, 1]])
    got = codes.sums(x, entry, 2)
    assert got[:4].tolist() == (x[0, 0] + x[1, 0]).tolist() and got[-6:].tolist() == [2, 0, 1, 1, 0, 2]


def test_sql_says_the_same(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf_dir}/embeddings.parquet'")
    want = sorted(con.sql(f"select vec_id, code, error, label_error, codebooks_sha256 from ({codes.ORACLE})").fetchall(), key=repr)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = found(queries.op13_vector_codes(spark, sf_dir))
    assert got == want == brute(rows)
