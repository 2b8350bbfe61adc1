"""A store that streams write: replays, failures and rivals change nothing twice."""

from __future__ import annotations

import pytest

from sparkreel.streaming import store

SCHEMA = "id long, status string, n int"


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=repr)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "jobs"), SCHEMA, "id", 4)
    change = store.upsert("id", ["n"])
    first = spark.createDataFrame([(1, "new", 1), (2, "new", 1), (1, "run", 2), (None, "x", 1)], SCHEMA)
    assert rows(table) == [] and table.merge(first, change, "q", 0)
    assert rows(table) == [(1, "run", 2), (2, "new", 1)] and table.version() == 1
    assert not table.merge(spark.createDataFrame([(1, "else", 9)], SCHEMA), change, "q", 0)  # whatever it holds
    assert table.merge(spark.createDataFrame([(3, "new", 1)], SCHEMA), change, "other", 0)
    assert table.merge(first.limit(0), change, "q", 1) and not table.merge(first, change, "q", 1)
    assert rows(table) == [(1, "run", 2), (2, "new", 1), (3, "new", 1)] and table.version() == 3
    assert rows(table, 1) == [(1, "run", 2), (2, "new", 1)]  # old readers keep their version


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "jobs"), SCHEMA, "id", 8)
    table.merge(spark.range(100).selectExpr("id", "'new' status", "1 n"), store.upsert("id", ["n"]), "q", 0)
    before = table.manifest()["buckets"]
    table.merge(spark.createDataFrame([(5, "run", 2)], SCHEMA), store.upsert("id", ["n"]), "q", 1)
    after = table.manifest()["buckets"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1 and len(rows(table)) == 100


def test_a_rival_of_the_same_version(spark, tmp_path, monkeypatch):
    """Another writer commits while we write: we merge again on top of it."""
    table, rival = (store.Table(spark, str(tmp_path / "jobs"), SCHEMA, "id", 4) for _ in range(2))
    change, done = store.upsert("id", ["n"]), []

    def slow(current, batch):
        if not done:
            done.append(rival.merge(spark.createDataFrame([(1, "rival", 1)], SCHEMA), change, "rival", 0))
        return change(current, batch)

    assert table.merge(spark.createDataFrame([(2, "ours", 1)], SCHEMA), slow, "q", 0) and done == [True]
    assert rows(table) == [(1, "rival", 1), (2, "ours", 1)] and table.version() == 2


def test_patches_are_folded_in_order(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "jobs"), SCHEMA, "id", 4)
    table.merge(spark.createDataFrame([(1, "new", 1), (2, "new", 1)], SCHEMA), store.upsert("id", ["n"]), "q", 0)
    patches = [(1, 1, "run", True, None, False), (1, 2, None, False, 7, True), (1, 3, "done", True, None, False), (2, 1, None, True, None, False), (9, 1, "lost", True, None, False)]
    df = spark.createDataFrame(patches, "id long, at int, status string, has_status boolean, n int, has_n boolean")
    table.merge(df, store.patched("id", ["status", "n"], ["at"]), "q", 1)
    assert rows(table) == [(1, "done", 7), (2, None, 1)]


def test_a_query_that_dies_after_its_merge(spark, tmp_path):
    """The batch is merged, the query fails before its checkpoint knows: the restart hands it over again, in vain."""
    table = store.Table(spark, str(tmp_path / "jobs"), SCHEMA, "id", 4)
    for k in range(3):
        spark.createDataFrame([(k, "new", k), (10, "new", k)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/b={k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    change, seen = store.upsert("id", ["n"]), []

    def dies(batch, k):
        seen.append((k, table.merge(batch, change, "q", k)))
        if len(seen) == 2:
            raise RuntimeError("power cut")

    q = stream.writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="power cut"):
        q.awaitTermination(60)
    version, held = table.version(), rows(table)
    q = stream.writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert q.exception() is None and seen == [(0, True), (1, True), (1, False), (2, True)]
    assert table.version() == version + 1 and len(held) < len(rows(table)) == 4
    q = store.sink(stream, table, change, "again", str(tmp_path / "state2"))
    q.awaitTermination(60)
    assert q.exception() is None and len(rows(table)) == 4
