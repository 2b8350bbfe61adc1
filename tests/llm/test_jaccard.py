from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import as_set, documents, rows, sentence

from sparkreel.llm import components, jaccard, queries


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows_):
    sets = [(d, shingles(t)) for d, t in rows_]
    by = defaultdict(list)
    for k, (d, s) in enumerate(sets):
        for x in s if d is not None else ():
            by[x].append(k)
    parent = {d: d for d, _ in rows_ if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (d, s) in enumerate(sets):
        common = defaultdict(int)
        for x in s if d is not None else ():
            for j in by[x]:
                if j < k:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((find(d), find(sets[j][0])))
                parent[b] = a
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=repr)


COLUMNS = ("doc_id", "n_shingles", "component_id")


def test_cases(spark):
    r = rows(4)
    assert as_set(jaccard.groups(documents(spark, r)), *COLUMNS) == brute(r)


def test_table(spark, sf_dir):
    r = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert as_set(queries.op4_jaccard_join(spark, sf_dir), *COLUMNS) == brute(r)


def test_borders(spark):
    """Families of variants around the threshold, a common passage, and chains that link step by step."""
    rng = random.Random(9)
    common, r, at = sentence(rng, 40, 9000).split(), [], 0
    for _ in range(25):
        base = sentence(rng, rng.randrange(5, 90), 9000).split()
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
            cut = rng.randrange(max(1, len(w) // 3))
            r.append((at := at + 1, " ".join((common if rng.random() < 0.4 else []) + w[cut:])))
    chain = sentence(rng, 400, 9000).split()
    r += [(5000 + k, " ".join(chain[k * 4 : k * 4 + 100])) for k in range(60)]
    assert as_set(jaccard.groups(documents(spark, r)), *COLUMNS) == brute(r)


def near_copies(rng, n, changes, words=120):
    """One text, and copies of it with some words changed, all different."""
    base = sentence(rng, words, 9000).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(len(w))] = f"x{k}y{rng.randrange(99)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("part", [4, 30])
def test_large_regions_are_split(spark, monkeypatch, part):
    """Groups of differing near copies, near and beyond the threshold, joined in parts: the links are few and lose nothing."""
    rng = random.Random(12)
    texts = near_copies(rng, 150, 8) + near_copies(rng, 80, 20) + near_copies(rng, 60, 60, 200) + [sentence(rng, 50, 9000) for _ in range(40)]
    texts += texts[:40]  # exact copies of members
    r = list(enumerate(texts))
    rng.shuffle(r)
    seen = []
    real = jaccard.components
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "components", lambda e: (seen.append(e.count()), real(e))[1])
    assert as_set(jaccard.groups(documents(spark, r)), *COLUMNS) == brute(r)
    assert len(seen) == 2  # both rounds took place


def test_a_region_gives_a_forest(spark):
    rng = random.Random(13)
    for changes in (5, 12, 40):
        texts = near_copies(rng, 300, changes)
        sets = [np.sort(np.array([hash(x) & (1 << 63) - 1 for x in shingles(t)], np.uint64)) for t in texts]
        s = jaccard.Sets(np.arange(300), np.array([len(x) for x in sets]), np.concatenate(sets))
        u, v = (np.concatenate(x) for x in zip(*jaccard.region_links(s, 0), strict=True))
        assert len(u) < 300 and (u != v).all()
        found = {d: c for d, _, c in brute(list(enumerate(texts)))}
        assert len(u) == 300 - len(set(found.values()))
        assert all(found[a] == found[b] for a, b in zip(u.tolist(), v.tolist(), strict=True))


def test_one_of_each(spark):
    r = [x for x in rows(6) if x[0] is not None]
    df = documents(spark, r)
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    # rows of an id that others have too are documents of their own, after all others
    ids = Counter(d for d, _ in r)
    again = sorted({x for x in r if ids[x[0]] > 1}, key=repr)
    own = [x for x in r if ids[x[0]] == 1] + [(10**9 + k, t) for k, (_, t) in enumerate(again)]
    want = [c for c in sorted({c for _, _, c in brute(own)})]
    assert sorted((x.doc_id, x.text or "") for x in got.collect()) == sorted((again[c - 10**9][0], again[c - 10**9][1] or "") if c >= 10**9 else (c, dict(own)[c] or "") for c in want)


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    rng = random.Random(7)
    w, x, y = (sentence(rng, 40, 9000) for _ in range(3))
    got = jaccard.one_of_each(documents(spark, [(1, w), (2, w), (2, y), (2, y), (3, x), (None, w), (None, w)]))
    assert as_set(got, "doc_id", "text") == sorted([(1, w), (2, y), (3, x), (None, w), (None, w)], key=repr)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_empty(spark):
    assert jaccard.groups(documents(spark, [(1, "x")]).limit(0)).count() == 0
    assert as_set(jaccard.groups(documents(spark, [(1, None), (2, ""), (3, None)])), *COLUMNS) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_equal_sets_meet_once(spark):
    """n copies give n - 1 twins, wherever they stand in a slice, and only one of them is in a region."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    text, others = sentence(rng, 40, 9000), [sentence(rng, 40, 9000) for _ in range(200)]
    r = [(k, text if k % 2 else others[k // 2]) for k in range(400)]
    hot = SimpleNamespace(value=np.zeros(1 << (jaccard.LATE_BITS - 6), np.uint64))
    slices = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array([t for _, t in part])], names=["doc_id", "text"]) for part in (r[:300], r[300:])]
    held = defaultdict(list)
    for rb in jaccard._lead_rows(hot, 3, 3)(slices):
        for b, block in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            held[b].append(block)
    twins = [x for b, blocks in held.items() if b < 0 for x in zip(*map(list, jaccard.bl.joined(blocks)), strict=True)]
    assert len(twins) == 150 - 1 + 50 - 1  # of each slice, to its first copy
    merged = [rb for b, blocks in held.items() if b >= jaccard.IDENTITY for rb in jaccard._pivots(3)([jaccard.bl.batch([(b, x) for x in blocks])])]
    links = [(u, v) for rb in merged for u, v in zip(rb.column(2).to_pylist(), rb.column(3).to_pylist(), strict=True) if u is not None]
    assert links == [(301, 1)]
    assert as_set(jaccard.groups(documents(spark, r)), *COLUMNS) == brute(r)
