from __future__ import annotations

import hashlib
import random

import numpy as np
from cases import as_set, documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkreel.llm import queries, suffix_array, suffix_dedup


def brute(rows_):
    least: dict[bytes, int] = {}
    for d, t in rows_:
        b = (t or "").encode()
        if d is not None:
            for k in range(len(b) - 49):
                w = b[k : k + 50]
                least[w] = min(d, least.get(w, d))
    out = []
    for d, t in rows_:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49) if d is not None else ():
            if least[b[k : k + 50]] < d:
                gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_cases(spark):
    r = rows(1)
    assert as_set(suffix_dedup.remove_covered(documents(spark, r)), *COLUMNS) == brute(r)


def test_table(spark, sf_dir):
    r = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert as_set(queries.op1_suffix_dedup(spark, sf_dir), *COLUMNS) == brute(r)


def test_hot_passage_and_group(spark):
    """Many copies and a common passage at shifting places: all but the smallest document lose them."""
    rng = random.Random(5)
    common = "".join(rng.choices("abcdefgh ", k=120))
    r = [(k, "".join(rng.choices("stuvwxyz ", k=rng.randrange(80))) + common + "".join(rng.choices("klmnop ", k=40))) for k in range(300)] + [(1000 + k, "the same text again and again, of more than fifty bytes in all") for k in range(200)]
    assert as_set(suffix_dedup.remove_covered(documents(spark, r)), *COLUMNS) == brute(r)


def test_shared_ids(spark):
    """Rows with one doc_id do not remove each other, and each loses only what is covered of its own text."""
    text = "a text that is surely longer than fifty bytes, and not repeated inside"
    other = "another text, which is not found anywhere else, and longer than fifty bytes too"
    for r in ([(7, text), (7, text), (9, text)], [(1, text), (2, text), (2, other)], [(-1, text), (None, text), (-2, text), (None, other)]):
        assert as_set(suffix_dedup.remove_covered(documents(spark, r)), *COLUMNS) == brute(r)


def test_empty(spark):
    assert suffix_dedup.remove_covered(documents(spark, [(1, "x")]).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=120), st.text("ab", max_size=120).map(str.encode), st.text("abc", min_size=1, max_size=4).map(lambda x: x.encode() * 40)))
def test_suffix_array(data):
    t = np.frombuffer(data, np.uint8)
    sa = suffix_array.suffix_array(t)
    want = sorted(range(len(data)), key=lambda k: data[k:])
    assert sa.tolist() == want
    lcp = suffix_array.common_prefixes(t, sa).tolist()
    for k in range(1, len(want)):
        a, b = data[want[k - 1] :], data[want[k] :]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 300), max_size=80), st.lists(st.integers(0, 2), max_size=200), st.lists(st.integers(0, 3), min_size=1, max_size=6).map(lambda x: x * 30)))
def test_names_are_ranked_by_recursion(names):
    _, dense = np.unique(np.array(names, np.int64), return_inverse=True)
    assert suffix_array.rank_names(dense).tolist() == sorted(range(len(names)), key=lambda k: names[k:])


def test_deep_recursion():
    """Words of few letters, so that several levels have equal names, against sorting by comparison."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("ab", k=rng.randrange(1, 5))) for _ in range(12)]
    data = " ".join(rng.choices(vocabulary, k=3000)).encode() * 2
    sa = suffix_array.suffix_array(np.frombuffer(data, np.uint8)).tolist()
    assert sa == sorted(range(len(data)), key=lambda k: data[k:])
