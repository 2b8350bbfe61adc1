"""Exports stand complete or not at all, and a task that runs twice leaves each file once."""

from __future__ import annotations

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkreel import constants as K
from sparkreel.sources import exports

FILES = "video_id long, source_video string, seq int, name string, content binary"


def test_files(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("f"), "id", F.lit(".png")).alias("name"), F.col("id").cast("string").cast("binary").alias("png")).repartition(5)
    out = exports.write_files(rows, str(tmp_path / "out"))
    assert sorted((r.name, r.bytes) for r in out.collect()) == sorted((f"f{k}.png", len(str(k))) for k in range(40))
    assert sorted(os.listdir(tmp_path)) == ["out"] and sorted(n for n in os.listdir(tmp_path / "out") if n.endswith(".png")) == sorted(f"f{k}.png" for k in range(40))
    assert (tmp_path / "out" / "f17.png").read_bytes() == b"17"
    with pytest.raises(FileExistsError):
        exports.write_files(rows, str(tmp_path / "out"))


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 99, F.raise_error("broken")).otherwise(F.col("id").cast("string").cast("binary")).cast("binary").alias("png")).repartition(4, "name")
    with pytest.raises(Exception, match="broken"):
        exports.write_files(rows, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_an_attempt_that_is_repeated(tmp_path):
    """A task that died in a file, and the one that repeats it: one complete file each, and no other name."""
    at = f"file://{tmp_path}/draft"
    first = exports._Draft(at)
    with first.open() as f:
        f.write(b"half")  # dies here
    done = exports._Draft(at)
    for _ in range(2):
        with done.open() as f:
            f.write(b"whole")
        assert done.finish("a.png") == 5
    assert sorted(os.listdir(tmp_path / "draft")) == ["_attempts", "a.png"] and (tmp_path / "draft" / "a.png").read_bytes() == b"whole"
    assert len(os.listdir(tmp_path / "draft" / "_attempts")) == 1


def test_archives(spark, tmp_path):
    files = [(v, "one.clip.mp4" if v < 3 else f"v{v}.mp4", k, f"{k:02d}.png", bytes([v]) * k) for v in range(1, 6) for k in range(12)]
    meta = spark.createDataFrame([(1, "[1]"), (4, "[4]"), (5, None), (9, "[9]")], "video_id long, metadata string")
    out = exports.write_archives(spark.createDataFrame(files, FILES).repartition(7), str(tmp_path / "zip"), meta).collect()
    names = {1: f"one.clip_1{K.ARCHIVE_SUFFIX}", 2: f"one.clip_2{K.ARCHIVE_SUFFIX}"} | {v: f"v{v}{K.ARCHIVE_SUFFIX}" for v in (3, 4, 5)}
    assert {r.name: r.members for r in out} == {n: 12 + (v in (1, 4)) for v, n in names.items()}
    for v, n in names.items():
        with zipfile.ZipFile(tmp_path / "zip" / n) as z:
            assert z.testzip() is None and z.namelist() == [f"{k:02d}.png" for k in range(12)] + ["metadata.json"] * (v in (1, 4))
            assert z.read("07.png") == bytes([v]) * 7
    assert {n for n in os.listdir(tmp_path / "zip") if n.endswith("zip")} == set(names.values())


def test_a_long_video_is_not_held(spark, tmp_path):
    """200 MB of one video go member by member."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        files = spark.range(100).select(F.lit(1).cast("long").alias("video_id"), F.lit("v.mp4").alias("source_video"), F.col("id").cast("int").alias("seq"), F.concat("id", F.lit(".png")).alias("name"), F.repeat(F.lit("x" * 1000), 2000).cast("binary").alias("content"))
        (r,) = exports.write_archives(files, str(tmp_path / "zip")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert r.members == 100 and r.bytes > 200_000_000
    with zipfile.ZipFile(tmp_path / "zip" / r.name) as z:
        assert z.getinfo("99.png").file_size == 2_000_000
