from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import pytest
from cases import as_set, documents, rows

from sparkreel.llm import mixing, queries, textkit  # noqa: F401


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(mixing.ORACLE).fetchall()
    names = [x[0] for x in con.description]
    assert sorted(map(tuple, want), key=repr) == as_set(queries.op3_temperature_mixing(spark, sf_dir), *names)


def test_every_document_and_repetitions(spark):
    r = rows(7)
    df = documents(spark, r)
    got = mixing.mix(df, repetitions=1.5, block_tokens=2000)
    assert got.columns[: len(df.columns) - 1] == [c for c in df.columns if c != "block"] or set(df.columns) <= set(got.columns)
    first = [x for x in got.select("doc_id", "text", "epoch").collect() if x.epoch == 0]
    assert Counter((x.doc_id, x.text) for x in first) == Counter(r)
    read, size = defaultdict(int), defaultdict(int)
    for x in got.select("source", "tokens", "epoch").collect():
        read[x.source] += x.tokens
        size[x.source] += x.tokens * (x.epoch == 0)
    largest = max(size.values())
    for s, n in size.items():
        if n:
            assert read[s] <= 1.5 * n + 0.001 * largest + 30_000  # at most one block's last document above


def test_weights_follow_the_exponent(spark):
    df = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10), ("d", 0)], "_source string, _tokens long")
    got = {r["_source"]: r for r in mixing.plan(df, repetitions=4.0, budget=1.0).collect()}
    a = got["a"]["exponent"]
    z = sum((n / 1110) ** a for n in (1000, 100, 10))
    for k, n in (("a", 1000), ("b", 100), ("c", 10)):
        assert got[k]["weight"] == pytest.approx((n / 1110) ** a / z)
        assert got[k]["quota"] / n <= 4.0 + 0.1
    assert got["d"]["quota"] == 0 and sum(x["weight"] for x in got.values()) == pytest.approx(1)
    # just below this exponent the smallest source would be repeated more often
    low = a - 1e-4
    assert 1110 * (10 / 1110) ** low / sum((n / 1110) ** low for n in (1000, 100, 10)) / 10 > 4.0
    assert {r["exponent"] for r in mixing.plan(df, repetitions=1e9, entropy=0.5, budget=1.0).collect()} != {0.0}


def test_empty(spark):
    assert mixing.mix(documents(spark, [(1, "x")]).limit(0)).count() == 0
    assert mixing.mix(documents(spark, [(1, None), (2, "")])).count() == 2


def test_texts_without_tokens_in_the_largest_source(spark):
    """Without a budget they are read once, wherever they stand."""
    rows_ = [(k, "w " * 20 if k % 2 else "", "big") for k in range(200)] + [(1000 + k, "w w", "small") for k in range(20)]
    df = spark.createDataFrame([(*r, 1) for r in rows_], "doc_id long, text string, source string, n int")
    for seed in range(3):
        first = [x.doc_id for x in mixing.mix(df, block_tokens=100, seed=seed).where("epoch = 0").select("doc_id").collect()]
        assert sorted(first) == sorted(r[0] for r in rows_)


def test_limits_that_cannot_be_met(spark):
    df = spark.createDataFrame([("a", 900), ("b", 100)], "_source string, _tokens long")
    for given in ({"repetitions": 1e9, "entropy": 0.1}, {"repetitions": 0.5}):
        assert {(r["exponent"], r["met"]) for r in mixing.plan(df, budget=1.0, **given).collect()} == {(1.0, False)}
    assert all(r["met"] for r in mixing.plan(df, repetitions=2.0, entropy=0.9, budget=1.0).collect())


def test_clashing_names(spark):
    names = "doc_id text source tokens blocks quota weight met exponent epoch _source _tokens _c0".split()
    df = spark.createDataFrame([(k, "a b c", "s", *[f"{n}{k}" for n in names[3:]]) for k in range(5)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names[3:]))
    got = mixing.mix(df)
    assert got.columns[: len(names)] == names and sorted(map(tuple, got.select(*names).distinct().collect())) == sorted(map(tuple, df.collect()))
