from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from cases import documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkreel.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def check(pieces, docs):
    """Every id in exactly one piece; sequences gapless, at most 4096, little padding."""
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    want = defaultdict(int)
    for d, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    full = dict(docs)
    for d, ps in by_doc.items():
        if sum(1 for x, _ in docs if x == d) > 1:
            continue
        ids = np.array(tok.encode(full[d] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert set(by_doc) == {d for d, _ in docs}
    total = padded = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 4096
        total += at
        padded += at if at & (at - 1) == 0 else 4096
    return total, padded


def test_table(spark, sf_dir):
    docs = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    total, padded = check(queries.op7_packing(spark, sf_dir).collect(), docs)
    assert total <= padded <= 1.02 * total + 4096


def test_cases(spark):
    r = rows(8) + [(9000 + k, t) for k, t in enumerate(["<|endoftext|> </s> [SEP] <s>", "a|b || |", "Don't stop,now!!  É À x", "a" * 20000, "　日本語 テスト", "x.y.z?!,;", "İstanbul ǅ ﬁ"])]
    check(packing.pack(documents(spark, r), PATH).collect(), r)


def test_empty(spark):
    assert packing.pack(documents(spark, [(1, "x")]).limit(0), PATH).count() == 0
    got = packing.pack(documents(spark, [(1, None)]), PATH).collect()
    assert [(p.start, p.length, p.doc_tokens, p.offset) for p in got] == [(0, 1, 1, 0)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 5)), min_size=1, max_size=9))
def test_program_is_optimal(steps):
    length = 10
    b = np.append(0, np.cumsum([s for s, _ in steps]))
    pen = np.array([0] + [p for _, p in steps[:-1]] + [0])

    def cost(at):
        at = [0, *at]
        pads = [0 if (n := b[j] - b[i]) & (n - 1) == 0 else length - n for i, j in zip(at, at[1:], strict=False)]
        return None if any(b[j] - b[i] > length for i, j in zip(at, at[1:], strict=False)) else sum(pads) + pen[at[1:]].sum()

    n = len(b) - 1
    best = min(c for m in product([0, 1], repeat=n - 1) if (c := cost([k + 1 for k in range(n - 1) if m[k]] + [n])) is not None)
    assert cost(packing.cuts(b, pen, length).tolist()) == best


@pytest.mark.parametrize("text", ["Hello, World! It's 12.5% of a|b.", "Ünïcödé ßtraße. \n\n tabs\t"])
def test_encoder(text):
    e = packing.Encoder(PATH)
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, ends, _ = e.encode(raw, np.array([0, len(raw)]))
    assert ids.tolist() == ids_of(text) and ends.tolist() == [len(ids)]
