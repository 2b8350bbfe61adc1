from __future__ import annotations

import random
import zlib

import numpy as np
from cases import as_set, documents

from sparkreel.llm import language, queries

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op9_language(spark, D)
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang is not None and r.n_chars > 60]
    assert len(held) > 50 and np.mean([r.lang_pred == r.lang for r in held]) >= 0.97


def corpus(n=60):
    rng = random.Random(1)
    words = {"aa": ["der", "und", "nicht", "straße"], "bb": ["the", "and", "with", "from"]}
    return [(k, " ".join(rng.choices(words[lang], k=30)), lang) for k in range(n) for lang in [rng.choice(sorted(words))]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, score string, held_out int").repartition(3)


def test_cases(spark):
    rows = corpus() + [(900, None, "aa"), (901, "", None), (902, "12 34 !!", "bb"), (903, "日本語", None), (None, "the and with from", "aa"), (904, "und nicht der " * 20_000, None), (0, "the and", "bb")]
    got = {(r.doc_id, r.score > 0): r.lang_pred for r in language.identify(frame(spark, rows)).collect()}
    assert got[900, False] == got[901, False] == got[902, False] == "und"
    assert got[903, False] in ("aa", "bb")  # letters of no known language: score 0
    assert got[904, True] == "aa" and got[None, True] == "bb"
    kept = {r.doc_id for r in language.known(frame(spark, rows)).collect()}
    assert kept == {r[0] for r in rows} - {900, 901, 902, 903}
    assert language.known(frame(spark, rows)).columns == frame(spark, rows).columns


def test_inputs_of_a_prediction(spark):
    """lang and doc_id of the predicted row do not matter, and held-out rows are not learned from."""
    rows = corpus()
    held = [k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 3 == 1][:50]
    a = as_set(language.identify(frame(spark, rows + [(k, "the and with", "cc") for k in held])), "doc_id", "lang_pred", "score")
    b = as_set(language.identify(frame(spark, rows + [(k, "the and with", None) for k in held])), "doc_id", "lang_pred", "score")
    assert a == b and "cc" not in {x[1] for x in a}


def test_no_training_and_empty(spark):
    rows = [(k, "some text", None) for k in range(5)]
    assert {r.lang_pred for r in language.identify(frame(spark, rows)).collect()} == {"und"}
    assert language.identify(documents(spark, [(1, "x")]).limit(0)).count() == 0


def test_filter_returns_all_languages_of_a_gram():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, 500).astype(np.uint64), rng.integers(0, 1 << 63, 500).astype(np.uint64)
    f = language.Filter.build({"a": a, "b": np.concatenate([b, a[:250]])})
    s = f.scores(np.concatenate([a, b]), np.repeat([0, 1], 500), 2)
    assert s[0, 0] > 0.999 and abs(s[0, 1] - 0.5) < 0.02 and s[1, 0] < 0.02 and s[1, 1] > 0.999


def test_more_than_64_languages(spark):
    """Every language has a bit, the rarest too."""
    names = [f"l{k:02d}" for k in range(70)]
    words = {x: ["".join(random.Random(f"{x}{j}").choices("abcdefghijklmnopqrstuvwxyz", k=6)) for j in range(8)] for x in names}
    rows = [(k * 70 + i, " ".join(words[x]), x) for k in range(8) for i, x in enumerate(names) if k < 7 or i < 64]
    got = language.identify(frame(spark, rows)).collect()
    want = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and {r.lang_pred for r in got} == set(names)
    assert all(r.lang_pred == want[r.doc_id] for r in got)


def test_capitals_are_small_letters():
    import numpy as np
    import pyarrow as pa

    from sparkreel.llm import textkit as tk

    def of(text):
        buf, off = tk.flat(pa.array([text]))
        return language.grams(buf, off)[0].tolist()

    for text in ("Hello World", "ÀÉÎÕÜÞ × ß", "ΑΒΓΔ ΟΠΡΣΤΥΦΧΨΩ", "ЁЂЏ АБВП РСТЯ", "日本語 É"):
        assert of(text) == of(text.lower()) and len(of(text)) > 0
    assert of("÷×") != of("÷÷") and np.unique(of("ПР")).size == len(of("ПР"))
