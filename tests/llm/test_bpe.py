from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from cases import documents, rows, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkreel.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.automaton(bpe.compiled(PATH)))


def agree(encoder, library, texts):
    ids, count = encoder.encode(texts)
    at = np.append(0, np.cumsum(count)).tolist()
    for t, i, j in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[i:j].tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert encoder.decode(ids, count) == texts == [library.decode(ids[i:j].tolist(), skip_special_tokens=False) for i, j in zip(at[:-1], at[1:], strict=True)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(library, pairs):
    out = []
    for d, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((d, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


ODD = ["", "it's we'll they've 're ''s 's \n's  'd 'll'", "  a  b\n\n c \t", "x" * 3000, "-" * 700 + " " * 90 + "!", "é€😀 　x y\x85z\x1c\x1d", "'", "a'", "a's", "\n", " ", "\x00\x01"]


def test_odd_texts(encoder, library):
    agree(encoder, library, ODD)
    agree(encoder, library, [])
    agree(encoder, library, ["<|endoftext|>a <|endoftext|> <|endoftext|><|endoftext|>b  <|endoftext|>", "", "<|endoftext|>", "none  ", "<|endoftext"])


@given(st.lists(st.text(st.one_of(st.sampled_from(" \n'aaabcdest rnliv.!?19éß中😀"), st.characters(exclude_categories=("Cs",))), max_size=80), max_size=20))
@settings(max_examples=150, deadline=None)
def test_any_text(texts):
    encoder, library = bpe.Encoder(bpe.automaton(bpe.compiled(PATH))), Tokenizer.from_file(PATH)
    agree(encoder, library, texts)


def test_words_alone_and_together(encoder, library):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 70))) for _ in range(3000)]
    for w in words:
        assert encoder.automaton.walk(w.encode()) == library.encode(w, add_special_tokens=False).ids
    agree(encoder, library, words)


def test_held_words_are_dropped(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_BYTES", 1000)
    rng = random.Random(5)
    for _ in range(5):
        agree(encoder, library, [sentence(rng, 60, 5000) for _ in range(5)])
    assert len(encoder.words) < 700


def by_merges(word, merges):
    """All merges in their order, each from left to right."""
    parts = list(word)
    for a, b in merges:
        k, out = 0, []
        while k < len(parts):
            if parts[k : k + 2] == [a, b]:
                out.append(a + b)
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out
    return parts


@pytest.mark.parametrize("seed", range(30))
def test_gadgets_of_random_merges(seed):
    """Small alphabets meet every kind of gadget: a with a, parts of parts, tokens that never meet."""
    rng = random.Random(seed)
    alphabet = "ab" if seed % 2 else "abc"
    tokens, merges = list(alphabet), []
    for _ in range(rng.randrange(1, 25)):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens:
            tokens.append(a + b)
            merges.append((a, b))
    number = {t: k for k, t in enumerate(tokens)}
    state, lacks = bpe.gadgets(list(range(len(alphabet))), [(number[a], number[b], number[a + b]) for a, b in merges], len(tokens))
    for _ in range(300):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12)))
        ways = [(0, [])]  # all accepted paths that spell the word
        found = []
        while ways:
            at, path = ways.pop()
            if at == len(word):
                found.append(path)
            s = int(state[number[path[-1]]]) if path else 0
            for t in tokens:
                if word.startswith(t, at) and not lacks[number[t], s >> 3] >> (s & 7) & 1:
                    ways.append((at + len(t), [*path, t]))
        assert found == [by_merges(word, merges)]


def test_refuses_other_tokenizers(tmp_path):
    with pytest.raises(ValueError):
        bpe.compile_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)
    model["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(model))
    with pytest.raises(ValueError):
        bpe.compile_tokenizer(str(tmp_path / "t.json"))


def test_awkward_rows(spark, library):
    pairs = rows(3, 30) + [(5000 + k, t) for k, t in enumerate(ODD)] + [(6000, "a <|endoftext|> b"), (None, None)]
    got = sorted(map(tuple, bpe.round_trip(documents(spark, pairs), PATH).collect()), key=repr)
    assert got == brute(library, pairs)


def test_ids_and_texts_are_columns(spark, library):
    docs = documents(spark, [(1, "Hello, world"), (2, None)])
    got = {r.doc_id: (r.ids, r.back) for r in bpe.decode(bpe.encode(docs, PATH), PATH, out="back").collect()}
    assert got == {1: (library.encode("Hello, world").ids, "Hello, world"), 2: ([], "")}
    odd = spark.createDataFrame([(1, [-1, 50256, None, 72, 10**6]), (2, None), (3, [149])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, PATH).orderBy("doc_id").collect()] == ["<|endoftext|>i", "", "�"]
    assert bpe.round_trip(docs.where("doc_id < 0"), PATH).collect() == []


def test_whole_table(spark, sf_dir, library):
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_bpe_round_trip(spark, sf_dir).collect()), key=repr) == brute(library, pairs)
