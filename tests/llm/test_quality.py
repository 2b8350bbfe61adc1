from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import documents, rows
from pyspark.sql import functions as F

from sparkreel.llm import quality, queries


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = {i for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for i in range(k, k + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def compare(got, docs):
    want = Counter((d, *brute(t)) for d, t in docs)
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def place(t):
    """Step on the path, computed from the text."""
    n, chars, symbols, dup, repeated = brute(t)
    if not n:
        return 0
    lines = sum(1 for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    return math.floor(min(max(0, symbols / n, 2 * repeated / n, dup / max(lines, 1), chars / n / 20, 1 - chars / n / 4), 0.999999) * 100)


def least_step(places, delta):
    """The strictest step that stands, by sums of binomial probabilities."""
    n, step = len(places), 100
    while step > 1:
        k = sum(p >= step - 1 for p in places)
        # the bound is at most ALPHA exactly if k or fewer of n have probability delta or less at ALPHA
        if k >= n or math.fsum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)) > delta:
            break
        step -= 1
    return step


def verdicts(docs, marks):
    """kept by row, independently: docs (doc_id, text, lang), marks (doc_id, quality)."""
    good = {d for d, q in marks if d is not None and q == 1}
    failed = lambda t: brute(t)[0] < 50 or 100 * brute(t)[4] > 50 * brute(t)[0]
    base, places = [failed(t) for _, t, _ in docs], [place(t or "") for _, t, _ in docs]
    held = defaultdict(list)
    for (d, _, lang), b, p in zip(docs, base, places, strict=True):
        if d in good and not b:
            held[lang].append(p)
    order = sorted(held, key=lambda x: (-len(held[x]), x or ""))
    need = lambda m: next(n for n in range(10**4) if 0.98**n <= 0.05 / m)
    m = max((k for k in range(1, len(order) + 1) if len(held[order[k - 1]]) >= need(k)), default=0)
    cut = {x: least_step(held[x], 0.05 / m) for x in order[:m]}
    return [(d, not b and p < cut.get(lang, 100)) for (d, _, lang), b, p in zip(docs, base, places, strict=True)]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_table(spark, folder):
    """Counts and verdicts of the whole table, computed a second time from the texts."""
    docs = [tuple(x) for x in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    marks = [tuple(x) for x in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()]
    got = queries.op8_quality_rules(spark, folder).collect()
    compare(got, [d[:2] for d in docs])
    assert sorted((r.doc_id, r.kept) for r in got) == sorted(verdicts(docs, marks))
    rejected = [r for r in got if not r.base_failed and not r.kept]
    assert all((r.rejected_by is None) == (r.kept or r.base_failed) for r in got)
    if folder.endswith("0.01"):
        assert len(rejected) > 20  # the rules have power


def test_strata_with_enough_labels_are_tested(spark):
    assert quality.needed(1) == 149 and 0.98**149 <= 0.05 < 0.98**148
    cases = [({"en": 5000, "de": 400}, {"en", "de"}), ({"en": 5000, "de": 182, "fr": 182}, {"en"}), ({"en": 5000, "de": 183, "fr": 183}, {"en", "de"}), ({"en": 214, "fr": 47, "de": 36}, {"en"}), ({"en": 148}, set()), ({}, set())]
    for labels_, want in cases:
        got = quality.tested(spark.createDataFrame(list(labels_.items()), "_s string, n long")).collect()
        assert {r._s for r in got} == want and {r._m for r in got} <= {len(want)}
    many = {f"l{k:03d}": 1000 for k in range(200)}  # no number of languages is special
    assert len(quality.tested(spark.createDataFrame(list(many.items()), "_s string, n long")).collect()) == 200


def symbols_text(rng, share):
    words = [f"{rng.choice('abcdefg')}{rng.randrange(10**6)}x" for _ in range(100)]
    for i in rng.sample(range(100), share):
        words[i] = f"#{rng.randrange(10**6)}"
    return " ".join(words)


def test_small_strata_lose_nothing(spark):
    """Good texts of a tiny stratum look like what a large one may reject, and so do texts of a language without labels: all stay."""
    rng = random.Random(15)
    docs = [(k, symbols_text(rng, 5), "en") for k in range(1000)] + [(2000 + k, symbols_text(rng, 60), "en") for k in range(50)]
    docs += [(3000 + k, symbols_text(rng, 50), "zz") for k in range(5)] + [(4000 + k, symbols_text(rng, 90), lang) for k, lang in enumerate(["yy", None, "yy"])]
    marks = [(k, 1, 0) for k in range(1000)] + [(2000 + k, 0, 0) for k in range(50)] + [(3000 + k, 1, 0) for k in range(5)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels(spark, marks)).collect()}
    assert all(got[d] == (not 2000 <= d < 3000) for d in got)
    assert sorted(got.items()) == sorted(verdicts(docs, [m[:2] for m in marks]))


def test_strata(spark):
    """Languages with labels of their own, a small one, and rows without a language."""
    rng, docs, marks = random.Random(14), [], []
    for k in range(1500):
        bad = k % 5 == 0
        lang = ["en", "en", "en", "de", None][k % 7 % 5]
        words = [f"{rng.choice('abcdefg')}{rng.randrange(10**6)}x" for _ in range(60)]
        for i in rng.sample(range(60), rng.randrange(25, 50) if bad else rng.randrange(4)):
            words[i] = "##"
        docs.append((k, " ".join(words), lang))
        marks.append((k, int(not bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = quality.judge(df, labels(spark, [(d, q, 0) for d, q in marks])).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == sorted(verdicts(docs, marks))
    assert {r.rejected_by for r in got} == {None, "symbols"}


def labels(spark, rows_):
    return spark.createDataFrame(rows_, "doc_id long, quality int, toxic int")


def test_cases(spark):
    r = rows(11) + [(8000, "a\n a\na\n\n \na"), (8001, "# * $ % & | < > [ ] ^"), (8002, "é€😀 x\x0by\x0cz\x85w")]
    got = quality.judge(documents(spark, r), labels(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, None)])).collect()
    compare(got, r)
    assert all(x.kept != x.base_failed for x in got)  # too few labels: nothing else is rejected
    assert quality.judge(documents(spark, r).limit(0), labels(spark, [])).count() == 0


def test_false_rejections_are_limited(spark):
    """Good documents with few symbols, bad ones with many: the rule rejects the bad and at most ALPHA of the good."""
    rng = random.Random(4)
    docs, marks = [], []
    for k in range(3000):
        good = k % 3 != 0
        words = [f"{rng.choice('abcdefg')}{rng.randrange(10**6)}x" for _ in range(60)]
        for i in rng.sample(range(60), rng.randrange(3) if good else rng.randrange(20, 50)):
            words[i] = "##"
        docs.append((k, " ".join(words)))
        marks.append((k, int(good), 0))
    got = {r.doc_id: r for r in quality.judge(documents(spark, docs).withColumn("lang", F.lit("en")), labels(spark, marks)).collect()}
    good = [got[d].kept for d, q, _ in marks if q]
    bad = [got[d].kept for d, q, _ in marks if not q]
    assert sum(good) >= (1 - quality.ALPHA) * len(good) and sum(bad) < 0.1 * len(bad)


def test_bound_is_exact():
    for k, n, delta in ((0, 50, 0.05), (3, 100, 0.01), (20, 400, 0.001), (5, 5, 0.05)):
        p = quality.upper_bound(k, n, delta)
        tail = lambda p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert p == 1.0 if k == n else abs(tail(p) - delta) < 1e-6


def test_cutoffs_keep_their_promise_often():
    """Over many drawn holdouts, some of several strata lose more than ALPHA of the good in at most DELTA of them."""
    rng, failures, powerful = np.random.default_rng(8), 0, 0
    for _ in range(200):
        drawn = {}
        for name, n in (("a", 300), ("b", 700), ("c", 2000)):
            places = np.minimum(quality.GRID - 1, rng.exponential(7, n).astype(int))
            drawn[name] = np.bincount(places, minlength=quality.GRID).tolist()
        cut = {name: quality.cutoff(by_step, len(drawn)) for name, by_step in drawn.items()}
        failures += any(c < quality.GRID and math.exp(-c / 7) > quality.ALPHA for c in cut.values())
        powerful += sum(c < quality.GRID for c in cut.values())
    assert failures <= 200 * quality.DELTA + 8 and powerful > 500
