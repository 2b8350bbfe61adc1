from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
from cases import documents, rows
from test_jaccard import brute as components
from test_packing import check
from test_substring_dedup import first_places, words

from sparkreel.llm import queries


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        seen[name] = (before, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    before, after = seen["language"]
    assert set(after) <= set(before) and len(after) >= 0.9 * len(before)
    before, after = seen["near_duplicates"]
    assert sorted(d for d, _ in after) == sorted({c for _, _, c in components(before)})
    before, after = seen["repeated_passages"]
    assert Counter((d, tuple(words(t))) for d, t in after) == Counter((d, tuple(w)) for (d, _), w in zip(before, first_places(before), strict=True))
    before, after = seen["source_mix"]
    assert set(after) == set(before)  # every document is read at least once
    packed = corpus_pipeline.sequences(spark, docs, sf_dir).collect()
    total, padded = check(packed, after)
    assert padded <= 1.02 * total + 4096 * 4
    assert len({zlib.crc32(str(r.doc_id).encode()) for r in packed}) <= len(set(after))


def test_run(spark, sf_dir):
    assert queries.pipeline(spark, sf_dir).count() > 0


def test_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and long texts, repeated rows, shared and null ids, names that clash: each stage alone, on all of them."""
    r = rows(5) + rows(5)[:7]
    docs = documents(spark, r)
    docs = docs.unionByName(docs.limit(1).selectExpr(*[f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in docs.schema]))
    both = Counter((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString(), name
        kept = Counter((x.doc_id, x.text) for x in got.select("doc_id", "text").collect())
        if name == "near_duplicates":
            assert set(kept) <= set(both) and kept[None, None] == both[None, None]
        if name == "repeated_passages":
            assert Counter(d for d, _ in kept.elements()) == Counter(d for d, _ in both.elements())
        if name == "source_mix":
            assert set(kept) == set(both) and all(kept[k] >= n for k, n in both.items())
    total, _ = check(corpus_pipeline.sequences(spark, docs, sf_dir).collect(), list(both.elements()))
    assert total > 0


def test_empty_table(spark, sf_dir):
    docs = documents(spark, [(1, "x")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
