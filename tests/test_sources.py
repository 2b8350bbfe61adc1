"""Containers, image folders, archives and the store's small rules."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreel import constants as K
from sparkreel.functions import expr as X
from sparkreel.operators import naming, ocr, store
from sparkreel.sources import images, mp4


def box(kind: bytes, *body: bytes) -> bytes:
    inner = b"".join(body)
    return struct.pack(">I4s", 8 + len(inner), kind) + inner


def full(kind: bytes, fmt: str, *values) -> bytes:
    return box(kind, b"\0\0\0\0", struct.pack(fmt, *values))


def movie(sizes, durations, shifts, sync, per_chunk, config=b"configuration", handler=b"vide", moov_first=False) -> tuple[bytes, list[bytes]]:
    """A small MP4 with one track, and its samples."""
    samples = [bytes([65 + k % 190]) * n for k, n in enumerate(sizes)]
    n = len(samples)
    entry = struct.pack(">I4s", 0, b"avc1") + b"\0" * 78 + box(b"pasp", b"avcC in the wrong place") + box(b"avcC", config)
    entry = struct.pack(">I", len(entry)) + entry[4:]
    chunks = [samples[k : k + per_chunk] for k in range(0, n, per_chunk)]
    tail = [(len(chunks), len(chunks[-1]), 1)] if len(chunks) > 1 and len(chunks[-1]) != per_chunk else []

    def moov(first):
        offsets, at = [], first
        for c in chunks:
            offsets.append(at)
            at += sum(map(len, c))
        runs = [(1, min(per_chunk, n), 1), *tail]
        stbl = box(
            b"stbl",
            box(b"stsd", struct.pack(">II", 0, 1), entry),
            full(b"stts", f">I{2 * n}I", n, *[x for d in durations for x in (1, d)]),
            full(b"ctts", f">I{'Ii' * n}", n, *[x for s in shifts for x in (1, s)]),
            full(b"stss", f">I{len(sync)}I", len(sync), *sync),
            full(b"stsz", f">II{n}I", 0, n, *sizes),
            full(b"stsc", f">I{3 * len(runs)}I", len(runs), *[x for r in runs for x in r]),
            full(b"stco", f">I{len(offsets)}I", len(offsets), *offsets),
        )
        media = box(b"mdia", full(b"mdhd", ">IIIIHH", 0, 0, 600, sum(durations), 0, 0), full(b"hdlr", ">I4s12x", 0, handler), box(b"minf", stbl))
        return box(b"moov", full(b"mvhd", ">96x"), box(b"trak", media))

    head, body = box(b"ftyp", b"isom\0\0\0\0"), box(b"mdat", *samples)
    if moov_first:
        return head + moov(len(head) + len(moov(0)) + 8) + body, samples
    return head + body + moov(len(head) + 8), samples


@pytest.mark.parametrize("moov_first", [False, True])
def test_demux_of_a_built_file(spark, tmp_path, moov_first):
    data, samples = movie([5, 3, 7, 2, 4], [100, 100, 50, 150, 100], [100, 300, -50, 0, 0], [1, 4], 2, moov_first=moov_first)
    other, _ = movie([1], [1], [0], [1], 1, handler=b"soun")
    bad = {"none": b"A" * 4096, "length": struct.pack(">I4s8x", 3, b"ftyp"), "bare": box(b"ftyp", b"12345678") + box(b"moov", box(b"mvhd", b"\0" * 100)), "sound": other}
    (tmp_path / "good.mp4").write_bytes(data)
    for name, content in bad.items():
        (tmp_path / f"{name}.MOV").write_bytes(content)
    (tmp_path / "notes.txt").write_bytes(b"no video")
    files = mp4.videos(spark, str(tmp_path))
    (tmp_path / "empty.mp4").write_bytes(b"")  # Spark gives no row for it
    with pytest.raises(ValueError):
        mp4.track(b"")
    assert files.count() == 5
    rows = mp4.demux(files).collect()
    good = sorted((r for r in rows if r.path.endswith("good.mp4")), key=lambda r: r.number)
    assert [(r.number, r.cts, r.duration, r.is_sync, r.codec, r.timescale) for r in good] == [(1, 100, 100, True, "avc", 600), (2, 400, 100, False, "avc", 600), (3, 150, 50, False, "avc", 600), (4, 250, 150, True, "avc", 600), (5, 400, 100, False, "avc", 600)]
    assert [data[r.offset : r.offset + r.size] for r in good] == samples
    assert mp4.track(data)["description"] == b"configuration"  # the box, not bytes that look like its name
    errors = {r.path.rsplit("/", 1)[1].split(".")[0]: r.error for r in rows if r.error}
    assert set(errors) == set(bad)
    scan = mp4.scan_boxes(files.where("path like '%good%'")).orderBy("i").collect()
    assert [(r.type, r.offset, r.size) for r in scan] == [(k, a, n) for _, k, a, n in mp4.boxes(data)]


def test_frames_of_a_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = [rng.integers(0, 256, (6, 4, 3)).astype(np.uint8) for _ in range(3)]
    for k in (2, 0, 1):
        (tmp_path / f"frame_{k + 1:04d}.png").write_bytes(images.png(made[k]))
    (tmp_path / "broken_0009.png").write_bytes(b"no image")
    got = images.read_frames(spark, str(tmp_path), 5).orderBy("idx").collect()
    assert [(r.video_id, r.idx, r.width, r.height) for r in got] == [(5, k, 4, 6) for k in range(3)]
    for r, want in zip(got, made, strict=True):
        assert (images.rgb(r.data, r.height, r.width, r.n_channels) == want).all()
    with pytest.raises(ValueError):
        images.rgb(b"123", 6, 4, 3)


def test_archives_and_written_files(spark, tmp_path):
    one = images.png(np.zeros((3, 2, 3), np.uint8))
    files = spark.createDataFrame([(1, "clip.one.mp4", 1, "b.png", one), (1, "clip.one.mp4", 0, "a.png", b"x"), (2, "v.mp4", 0, "c.png", b"y")], "video_id long, source_video string, seq int, name string, content binary")
    meta = spark.createDataFrame([(1, '[{"file":"a.png"}]')], "video_id long, metadata string")
    rows = {r.video_id: r for r in images.zip_archives(files, meta).collect()}
    assert rows[1].archive == "clip.one" + K.ARCHIVE_SUFFIX
    z = zipfile.ZipFile(io.BytesIO(rows[1].content))
    assert z.namelist() == ["a.png", "b.png", "metadata.json"] and z.read("b.png") == one and json.loads(z.read("metadata.json"))[0]["file"] == "a.png"
    assert zipfile.ZipFile(io.BytesIO(rows[2].content)).namelist() == ["c.png"]
    out = images.write_pngs(files.withColumnRenamed("content", "png"), folder=str(tmp_path / "out")).collect()
    assert sorted((r.name, r.bytes) for r in out) == [("a.png", 1), ("b.png", len(one)), ("c.png", 1)]
    assert (tmp_path / "out" / "b.png").read_bytes() == one


def test_rows_of_a_tall_image():
    img = np.random.default_rng(2).integers(0, 256, (50, 9, 3)).astype(np.uint8)
    tall = images.TallPng(9)
    for k in range(0, 50, 7):
        tall.add(img[k : k + 7])
    assert tall.finish() == images.png(img)
    assert images.eased(30, 3) == [21, 29, 30]


def test_crops_of_attempts_only(spark):
    frames = images.synthetic(spark, mails=1)
    tried = spark.createDataFrame([(0, 0, 3, 1), (0, 0, 99, 2)], "video_id long, seg int, idx int, attempt int")
    got = ocr.crops(frames, tried).collect()
    assert [(r.idx, r.attempt) for r in got] == [(3, 1)]
    w, h = struct.unpack_from(">II", got[0].timestamp_png, 16)
    assert (w, h) == (2 * (129 - int(129 * 0.55)), 2 * (int(280 * 0.18) - int(280 * 0.13)))


def test_store_rules(spark):
    jobs = spark.createDataFrame([("a", "x", 1, "running", 1, 5), ("b", "x", 1, "done", 2, 5), ("c", "y", 1, "done", 1, 9)], "id string, owner_id string, heartbeat_at long, status string, created_at long, updated_at long")
    assert [r.id for r in store.listed(jobs).collect()] == ["c", "b", "a"]
    patches = spark.createDataFrame([("a", None, True), ("new", "failed", True), ("gone", "failed", True)], "id string, status string, has_status boolean")
    back = spark.createDataFrame([("new", "z", 7, "running", 3, 3), ("a", "z", 7, "running", 3, 3)], jobs.schema)
    got = {r.id: (r.owner_id, r.status, r.updated_at) for r in store.patch(jobs, patches, "id", ["status"], F.lit(50).cast("long"), back).collect()}
    assert got == {"a": ("x", None, 50), "b": ("x", "done", 5), "c": ("y", "done", 9), "new": ("z", "failed", 50)}
    assert store.cleared(jobs).count() == 0 and store.cleared(jobs).schema == jobs.schema


def test_names_and_stalls(spark):
    rows = [("mail", 3, 1, 2.5, False, None, 1), ("mail", 3, 1, 2.5, True, None, 1), ("mail", 3, 1, 2.5, True, 2, 3), ("image", 3, 1, 2.5, False, None, 1)]
    df = spark.createDataFrame(rows, "kind string, n int, seg int, t double, stitched boolean, part int, total int")
    got = df.select(naming.provisional_name(*[F.col(c) for c in ("kind", "n", "seg", "t", "stitched", "part", "total")])).collect()
    assert [r[0] for r in got] == ["mail_03_seg1_t2.500.png", "mail_03_seg1_t2.500_stitched.png", "mail_03_seg1_t2.500_p2of3.png", "image_003.png"]
    silent = spark.createDataFrame([(True, 180_000), (True, 180_001), (True, 600_001), (False, 900_000)], "running boolean, ms long")
    assert [r[0] for r in silent.select(X.stall(F.col("running"), F.col("ms"))).collect()] == [None, "warn", "abort", None]


def columns(rows):
    return [(r.number, r.cts, r.duration, r.is_sync, r.offset, r.size) for r in sorted(rows, key=lambda r: r.number)]


@pytest.mark.parametrize("per_chunk", [1, 3, 50])
def test_mp4_source_splits_a_file(spark, tmp_path, per_chunk):
    """Any split gives the samples that one pass over the whole bytes gives, with their bytes."""
    n = 50
    data, made = movie([1 + 7 * k % 30 for k in range(n)], [10 + k % 3 for k in range(n)], [(-5) ** (k % 2) * k for k in range(n)], [1, 20, 41], per_chunk, moov_first=per_chunk == 3)
    (tmp_path / "a.mp4").write_bytes(data)
    want = mp4.track(data)
    assert [data[s[4] : s[4] + s[5]] for s in want["samples"]] == made
    for split in (1 << 20, 400, 37):
        got = mp4.samples(spark, str(tmp_path), media=True, bytes_per_partition=split)
        assert got.rdd.getNumPartitions() == -(-len(data) // split)
        rows = got.collect()
        assert columns(rows) == want["samples"]
        assert [bytes(r.data) for r in sorted(rows, key=lambda r: r.number)] == made
        assert {(r.codec, bytes(r.description), r.timescale, r.error) for r in rows} == {("avc", b"configuration", 600, None)}


def test_mp4_source_of_odd_files(spark, tmp_path):
    other, _ = movie([1], [1], [0], [1], 1, handler=b"soun")
    bad = {"none": b"A" * 4096, "length": struct.pack(">I4s8x", 3, b"ftyp"), "bare": box(b"ftyp", b"12345678") + box(b"moov", box(b"mvhd", b"\0" * 100)), "sound": other, "empty": b""}
    for name, content in bad.items():
        (tmp_path / f"{name}.MOV").write_bytes(content)
    (tmp_path / "notes.txt").write_bytes(b"no video")
    rows = mp4.samples(spark, str(tmp_path), bytes_per_partition=64).collect()
    assert sorted(r.path.rsplit("/")[-1] for r in rows) == sorted(f"{n}.MOV" for n in bad) and all(r.error for r in rows)
    assert mp4.samples(spark, str(tmp_path / "sound.MOV")).collect()[0].error == "no video track"


def test_mp4_source_of_a_file_over_2_gb(spark, tmp_path):
    """Media first, tables last, 3 GB between: the tables are found by seeking and no task reads the rest."""
    gap, n = 3 << 30, 2000
    media = [bytes([k % 251]) * 5 for k in range(n)]
    head = box(b"ftyp", b"isom\0\0\0\0")
    body = struct.pack(">I4sQ", 1, b"mdat", 16 + gap + 5 * n)
    first = len(head) + 16 + gap
    entry = struct.pack(">I4s", 0, b"hvc1") + b"\0" * 78 + box(b"hvcC", b"cfg")
    entry = struct.pack(">I", len(entry)) + entry[4:]
    stbl = box(
        b"stbl",
        box(b"stsd", struct.pack(">II", 0, 1), entry),
        full(b"stts", ">III", 1, n, 20),
        full(b"stsz", ">II", 5, n),
        full(b"stsc", ">IIII", 1, 1, 100, 1),
        full(b"co64", f">I{n // 100}Q", n // 100, *[first + 500 * k for k in range(n // 100)]),
    )
    tail = box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", ">IIIIHH", 0, 0, 600, 20 * n, 0, 0), full(b"hdlr", ">I4s12x", 0, b"vide"), box(b"minf", stbl))))
    with open(tmp_path / "long.mp4", "wb") as f:
        f.write(head + body)
        f.seek(first)
        f.write(b"".join(media) + tail)
    got = mp4.samples(spark, str(tmp_path / "long.mp4"), media=True)
    assert got.rdd.getNumPartitions() == 13
    rows = sorted(got.collect(), key=lambda r: r.number)
    assert [bytes(r.data) for r in rows] == media and [r.cts for r in rows] == [20 * k for k in range(n)]
    assert rows[-1].offset == first + 5 * (n - 1) and rows[0].codec == "hevc" and all(r.is_sync for r in rows)


def test_mp4_tables_are_read_by_range():
    """A run in the middle costs its own sizes, not the file's."""
    n = 60_000
    data, _ = movie([1 + k % 5 for k in range(n)], [10] * n, [0] * n, list(range(1, n, 100)), 30)

    class Counted(io.BytesIO):
        read_ = 0

        def read(self, size=-1):
            got = super().read(size)
            self.read_ += len(got)
            return got

    f = Counted(data)
    t = mp4.open_track(f, len(data))
    head = f.read_
    got = t.samples(f, 100, 200)
    assert head < 2000 and f.read_ - head < 1_200_000 < len(data)  # run-length tables are read block by block
    want = mp4.track(data)["samples"][100:200]
    assert list(zip(*(c.tolist() for c in got.values()), strict=True)) == want
