"""Kernels against their definitions, the whole plan on a made-up recording, and streams against batch."""

from __future__ import annotations

import io
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreel import constants as K
from sparkreel.functions import correlate, pixels, stitch
from sparkreel.functions import expr as X
from sparkreel.operators import frames as fr
from sparkreel.operators import select
from sparkreel.plans import bindings as B
from sparkreel.plans import queries, recordings
from sparkreel.sources import images, mp4
from sparkreel.streaming import frames as streams


def test_transform_follows_its_definition():
    x = np.random.default_rng(0).integers(0, 256, (8, 8))
    got = pixels.dct2(x)
    for u, v in ((0, 0), (1, 3), (7, 7), (4, 0)):
        want = sum(4 * x[i, j] * math.cos(math.pi * u * (2 * i + 1) / 16) * math.cos(math.pi * v * (2 * j + 1) / 16) for i in range(8) for j in range(8))
        assert got[u, v] == pytest.approx(want, abs=1e-6)


def test_hash_is_stable_under_brightness_and_differs_between_pages():
    rng = np.random.default_rng(1)
    smooth = np.kron(rng.integers(40, 200, (6, 6)), np.ones((50, 50))).astype(np.uint8)
    other = np.kron(rng.integers(40, 200, (6, 6)), np.ones((50, 50))).astype(np.uint8)
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert bits(pixels.phash(smooth), pixels.phash(smooth + 10)) <= 2 < 12 < bits(pixels.phash(smooth), pixels.phash(other))


def test_resampling():
    g = np.random.default_rng(2).integers(0, 256, (40, 60)).astype(np.uint8)
    assert (pixels.resize(g, 60, 40, "bicubic") == g).all()
    flat = np.full((40, 60), 137, np.uint8)
    assert (pixels.resize(flat, 17, 23, "lanczos") == 137).all()
    for name in ("bicubic", "lanczos"):
        k = pixels.coefficients(60, 17, name)
        whole = np.clip((k @ g.T.astype(np.int64) + (1 << (pixels.BITS - 1))) >> pixels.BITS, 0, 255).T
        assert (pixels.resize(g, 17, 40, name) == whole).all()
        assert np.abs(k.sum(axis=1) - (1 << pixels.BITS)).max() <= k.shape[1]
    assert pixels.box_mean(np.array([[0, 1], [1, 0]], np.uint8), 2).tolist() == [[1]]  # a half is rounded up


def test_correlation_finds_shifts():
    page = np.random.default_rng(3).integers(0, 256, (260, 120)).astype(np.float64)
    for dy in (3, 17, 40):
        dx, y, response = correlate.correlate(page[:200], page[dy : dy + 200])
        assert abs(dx) < 0.1 and abs(abs(y) - dy) < 0.1 and response > 0.2
    sizes = [n for n in range(1, 2000) if all(p in (2, 3, 5) for p in _factors(n))]
    for n in range(1, 1900):
        assert correlate.optimal_size(n) == next(s for s in sizes if s >= n)


def _factors(n):
    p, out = 2, set()
    while n > 1:
        while n % p == 0:
            out.add(p)
            n //= p
        p += 1
    return out


def test_stitch_restores_a_scrolled_page():
    page = np.random.default_rng(4).integers(0, 256, (500, 100)).astype(np.uint8)
    tops = [0, 0, 12, 45, 45, 80, 120]
    canvas, made = stitch.stitch([page[y : y + 200] for y in tops])
    assert [d["reason"] for d in made] == ["first", "static", None, None, "static", None, None]
    assert [d["add_rows"] for d in made] == [200, 0, 12, 33, 0, 35, 40]
    assert (canvas == page[:320]).all()
    assert stitch.best_match(page, page[77:97]) == pytest.approx(1.0)
    assert [stitch.refusal(*x) for x in ((0, 2, 0.7), (12, 5, 0.9), (12.1, 5, 0.9), (0, 5, 0.69), (0, 1.9, 0.9), (0, -9, 0.9))] == [None, None, "weak_or_shift", "weak_or_shift", "static", "static"]


def test_header_is_learnt_and_canvas_is_capped():
    rng = np.random.default_rng(5)
    page, top = rng.integers(0, 256, (600, 100)).astype(np.uint8), np.full((30, 100), 90, np.uint8)
    frames = [np.concatenate([top, page[y : y + 270]]) for y in (0, 10, 25, 60)]
    header = stitch.Header(auto=True)
    canvas, made = stitch.stitch(frames, header)
    assert header.rows == 30 and (canvas == np.concatenate([top, page[:330]])).all()
    carried = stitch.Header(rows=70, auto=True)
    stitch.stitch(frames, carried)
    assert carried.rows == 30  # the first estimate replaces what was carried
    carried.learn(frames[0], frames[0])
    assert carried.rows == 30  # equal frames estimate a quarter of the height: later ones only lower it
    capped, _ = stitch.stitch(frames, stitch.Header(rows=30), limit=320)
    assert len(capped) == 310  # 300 rows, 10 more; 15 and 35 do not fit
    c = stitch.Canvas(100)
    assert [c.place(n) for n in (120, 1)] == [100, 0] and c.truncated == 21


def test_reduced_size_is_rechecked_when_unsure(monkeypatch):
    page = np.kron(np.random.default_rng(6).integers(0, 256, (200, 60)), np.ones((2, 2))).astype(np.uint8)
    frames = [page[y : y + 240] for y in (0, 16, 40)]
    for scale in (1, 2):
        canvas, _ = stitch.stitch(frames, scale=scale, recheck=True)
        assert (canvas == page[:280]).all()
    seen = []
    real = stitch.C.shift
    monkeypatch.setattr(stitch.C, "shift", lambda a, b, rows, cols: (seen.append((rows, cols)), (*real(a, b, rows, cols)[:2], 0.6))[1])
    stitch.scroll(stitch.Spectra(), 1, frames[0], frames[1], 0, 2, True)
    assert seen == [(120, 60), (240, 120)]


def test_fixed_values():
    gray = {(255, 255, 255): 255, (0, 0, 0): 0, (255, 0, 0): 76, (0, 255, 0): 150, (0, 0, 255): 29, (240, 200, 210): 213, (37, 201, 99): 140, (130, 130, 130): 130}
    for px, want in gray.items():
        assert pixels.gray_pillow(np.array([[px]], np.uint8))[0, 0] == want
    assert [(r.start, r.stop) for r in (pixels.rows_of(2796, p) for p in (K.BODY_Y, K.DARK_TOP_Y, K.DARK_BOTTOM_Y))] == [(782, 2516), (279, 447), (2572, 2740)]
    assert [correlate.optimal_size(n) for n in (1290, 2642, 1, 7, 2796)] == [1296, 2700, 1, 8, 2880]
    saturated = lambda px: pixels.metrics(np.full((100, 100, 3), px, np.uint8))[2]
    assert saturated((100, 80, 80)) == 0 and saturated((100, 79, 79)) == 1
    for px, want in (([1, 2, 3, 5], 3), ([1, 1, 2, 3], 2), ([0, 1, 1, 1], 1), ([0, 0, 1, 0], 0)):
        assert pixels.box_mean(np.array(px, np.uint8).reshape(2, 2), 2)[0, 0] == want
    assert pixels.box_mean(np.array([[1, 2, 9], [3, 4, 9], [0, 0, 9]], np.uint8), 2).tolist() == [[3]]
    a = np.full((200, 10), 200, np.uint8)
    b = a.copy()
    b[30:] = 50
    assert pixels.fixed_rows(a, b) == 30 and pixels.fixed_rows(a, a) == 50
    b[30] = 200
    b[30, 0] = 205
    assert pixels.fixed_rows(a, b) == 31
    assert correlate.window(3, 3)[1, 1] == 1 and correlate.window(5, 5)[0].max() == 0


def test_texts(spark):
    one = lambda c, *rows: [r[0] for r in spark.createDataFrame([(r,) for r in rows], "s string").select(c(F.col("s"))).collect()]
    assert one(X.parse_timestamp, "2026-08-25 22:59", " 2026-08-25 22:59\n", "2026-08-2522:59", "2026-08-25 2259", "-- 2026-08-23 21:07 :") == ["2026-08-25_2259"] * 4 + ["2026-08-23_2107"]
    assert one(X.parse_timestamp, "2026-02-31 12:00", "2026-08-25 25:99", "1999-08-25 22:59", "2026-08-25", "", None) == [None] * 6
    assert one(X.parse_timestamp, "2024-02-29 00:00") == ["2024-02-29_0000"]
    assert one(X.format_timestamp, "2026-08-25_2259", "unknown") == ["2026-08-25 22:59", "unknown"]
    assert one(X.normalize_timestamp, "2026-08-25 22:59", "2026-08-25_2259", "2026/8/5 7:03", "2026-13-01 10:00", "2026-08-25 24:00", "abc") == ["2026-08-25_2259", "2026-08-25_2259", "2026-08-05_0703", None, None, None]
    assert one(X.clean_sender, " 渋 井 美 奈 \n", "|渋井  美奈|", "Yuki Kashiwagi", "\n\n", "a\u3000b", None) == ["渋井美奈", "渋井美奈", "Yuki Kashiwagi", None, "a b", None]


def test_categories_at_their_edges(spark):
    rows = [(0.5, 0.5), (0.5, 0.501), (0.0199, 0.5), (0.02, 0.0), (0.1499, 0.0), (0.15, 0.0)]
    got = spark.createDataFrame(rows, "bm double, dk double").select(X.categorize(F.col("bm"), F.col("dk"))).collect()
    assert [r[0] for r in got] == ["detail", "fullscreen_image", "loading", "list", "list", "detail"]


@pytest.mark.parametrize("rate,count,first,every", [(60, 1851, 4, 10), (30, 30, 2, 5)])
def test_samples_of_whole_recordings(spark, rate, count, first, every):
    us = lambda n: round(n * 1e6 / rate)
    rows = [(1, n, 1_000_000 + us(n), round(1e6 / rate)) for n in range(count)]
    e = spark.createDataFrame(rows, "video_id long, n long, ts_us long, dur_us long")
    t0 = F.lit(1_000_000).cast("long")
    got = fr.resample(e, X.slot_of(F.col("ts_us"), t0), X.slot_of(F.col("ts_us") + F.col("dur_us"), t0)).orderBy("slot").collect()
    assert [(r.slot, r.n) for r in got][:5] == [(k, every * k + first) for k in range(5)]
    assert len(got) == (185 if count == 1851 else 6)


def test_boxes():
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    data = box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"mdat", 20) + b"abcd" + struct.pack(">I4s", 0, b"free") + b"rest"
    assert list(mp4.boxes(data)) == [(0, "ftyp", 0, 12), (1, "mdat", 12, 20), (2, "free", 32, 12)]
    with pytest.raises(ValueError):
        list(mp4.boxes(struct.pack(">I4s", 4, b"bad ")))


def test_greedy_and_held_selection(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(12)]
    rows = [(v, k, rng.choice(base) ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60))) for v in range(3) for k in range(40)]
    near = lambda a, b: (a ^ b).bit_count() <= 6
    want = set()
    for v in range(3):
        kept = []
        for _, k, h in sorted(r for r in rows if r[0] == v):
            if not any(near(h, x) for x in kept):
                kept.append(h)
                want.add((v, k))
    got = select.greedy(spark.createDataFrame(rows, "video_id long, idx int, h long"), ["video_id"], ["idx"], "h", 6)
    assert {(r.video_id, r.idx) for r in got.where("kept").collect()} == want
    image = lambda k, h: {"idx": k, "bm": 0.1, "h": h, "from_stable": True}
    far = [sum(1 << (b * 8 + k) for b in range(8)) for k in range(8)]
    events = select.close_segments([{"seg": 0, "mail": image(9, far[0]), "images": [image(k, far[k]) for k in range(6)]}], 6, 4)
    # held before the mail is judged: the image like the mail goes as a repeat, the fifth and sixth as overflow
    assert [(e[1], e[2], e[6], e[7]) for e in events] == [("mail", 9, "selected", None), ("image", 0, "skipped", "duplicate"), ("image", 1, "selected", None), ("image", 2, "selected", None), ("image", 3, "selected", None), ("image", 4, "skipped", "pending_overflow"), ("image", 5, "skipped", "pending_overflow")]


def test_held_selection_of_many_videos(spark, capsys):
    """No group per video; segments and videos go over Arrow batches, and a task hands over more than one batch of events."""
    rng = random.Random(8)
    base = [rng.getrandbits(62) for _ in range(5)]
    rows = [(0, k, k, "detail", 0.5, base[k % 3] ^ (1 << rng.randrange(40))) for k in range(11_000)]
    rows += [(None if v == 1 else v, k // 12, k, rng.choice(["detail", "fullscreen_image", "fullscreen_image", "list"]), rng.choice([None, 0.2, 0.7]), rng.choice([None, *base])) for v in range(1, 301) for k in range(30)]
    near = lambda a, b, d: a is not None and b is not None and (a ^ b).bit_count() <= d
    want, video = [], ...
    for v, seg, idx, cat, bm, h in [*rows, (..., None, None, None, None, None)]:
        if v != video or seg != at:  # the segment before is over
            if video is not ...:
                for kind, from_stable, b, i, x in ([("mail", mail[0], mail[3], -mail[2], mail[4])] if mail else []) + [("image", True, *y) for y in held]:
                    dup = any(near(x, y, 6) for y in seen)
                    seen += [] if dup or x in seen else [x]
                    want.append((video, at, kind, i, b, x, from_stable, *(("skipped", "duplicate") if dup else ("selected", None))))
                want += [(video, at, "image", i, b, x, True, "skipped", "pending_overflow") for b, i, x in over]
            seen = seen if v == video else []
            video, at, last, mail, held, over = v, seg, {}, None, [], []
        stable = near(h, last.get(cat), 2)
        last[cat] = h
        if cat == "detail":
            item = (stable, -1.0 if bm is None else bm, -idx, bm, h)
            mail = item if mail is None or item[:3] > mail[:3] else mail
        if cat == "fullscreen_image" and stable and not any(near(h, x, 6) for x in seen) and not any(near(h, x[2], 6) for x in held):
            (held if len(held) < 2 else over).append((bm, idx, h))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = select.select_events_held(select.stability(spark.createDataFrame(rows, "video_id long, seg int, idx int, cat string, bm double, h long")), limit=2)
        assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r[8] for r in want} == {None, "duplicate", "pending_overflow"}
    got.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out


def test_pairs_by_bands(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(10)]
    rows = [(k, base[k % 10] ^ sum(1 << b for b in rng.sample(range(60), rng.randrange(5)))) for k in range(80)]
    want = {(i, j) for i, a in rows for j, b in rows if i < j and ((a ^ b) & (1 << 64) - 1).bit_count() <= 6}
    got = select.candidate_edges(spark.createDataFrame(rows, "id long, h long"), "id", "h", 6)
    assert {(r.a, r.b) for r in got.collect()} == want


def _png_size(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, raw, size = 8, io.BytesIO(), None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            size = struct.unpack_from(">II", data, at + 8)
        if kind == b"IDAT":
            raw.write(data[at + 8 : at + 8 + n])
        at += 12 + n
    assert len(zlib.decompress(raw.getvalue())) > 0
    return size


def test_whole_plan(spark):
    truth = {}
    frames = images.synthetic(spark, truth=truth)
    out = recordings.exported(frames).orderBy("seg").collect()
    mails = [r for r in out if r.kind == "mail" and r.event == "selected"]
    assert len(mails) == 3 and len({r.seg for r in mails}) == 3
    for r in mails:
        width, height = _png_size(r.png)
        assert r.stitched and width == 129 and abs(height - len(truth[r.seg])) <= 0.01 * len(truth[r.seg])
    pixels_ = _pixels(mails[0].png)
    band = truth[0][-40:-20, :, 0].astype(np.uint8)
    assert stitch.best_match(pixels_[:, :, 0], band) > 0.99


def test_stitched_videos_hold_one_frame(spark):
    frames = images.synthetic(spark)
    seg = fr.segments(fr.classify(recordings.measured(frames)))
    plain = recordings.stitched(frames, seg).drop("png").orderBy("seg").collect()
    learnt = recordings.stitched(frames, seg, auto=True).drop("png").orderBy("seg").collect()
    assert [r.seg for r in plain] == [r.seg for r in learnt] == [0, 1, 2] and all(r.accepted >= 3 for r in plain)
    plan = recordings.stitched(frames, seg)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "BroadcastHashJoin" in plan


def _pixels(data):
    at, raw = 8, b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        raw += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    w, h = _png_size(data)
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


def run_stream(spark, rows, schema, op, tmp_path, parts):
    """Feeds rows in order as one file a batch, and returns all that came out."""
    folder, name = tmp_path / "in", f"s{random.getrandbits(40)}"
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b={k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # as many state stores
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep it running
    q = op(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    q.awaitTermination(120)
    assert q.exception() is None
    return [tuple(r) for r in spark.table(name).collect()]


def test_stream_of_segments(spark, tmp_path):
    rng = random.Random(7)
    rows = [(v, k, rng.choice(["detail", "list", "loading"]), rng.random() < 0.3) for k in range(60) for v in range(3)]
    schema = "video_id long, idx int, cat string, boundary boolean"
    got = run_stream(spark, rows, schema, streams.segment, tmp_path, 3)
    want = fr.segments(spark.createDataFrame(rows, schema).withColumn("t", F.lit(0.0))).select("video_id", "idx", "cat", "seg")
    assert sorted(got) == sorted(tuple(r) for r in want.collect())


def test_stream_of_samples(spark, tmp_path):
    rng, rows, ts = random.Random(8), [], 0
    for n in range(50):
        dur = rng.choice([10_000, 90_000, 170_000, 900_000])
        rows.append((1, n, ts, dur, False))
        ts += dur
    rows.append((1, 50, None, None, True))
    got = run_stream(spark, rows, "video_id long, n long, ts_us long, dur_us long, end boolean", lambda s: streams.sample(s, 6.0), tmp_path, 4)
    slot = lambda t: math.floor(t * 6 / 1e6 + 0.5 + 1e-4)
    want, nxt = [], 0
    for k, (_, n, t, dur, _) in enumerate(rows[:-1]):
        upto = slot(rows[k + 1][2]) if k < 49 else slot(t + dur)
        while nxt < upto:
            want.append((1, nxt, n))
            nxt += 1
    assert sorted(got) == want


def plain_greedy(rows, distance=6):
    """(key, place) of the kept of (key, place, hash)."""
    seen, out = {}, set()
    for key, at, h in sorted(rows, key=lambda r: (r[1], r[2] is None, r[2] and r[2] & (1 << 64) - 1)):
        if h is None or all(((h ^ x) & (1 << 64) - 1).bit_count() > distance for x in seen.setdefault(key, [])):
            out.add((key, at))
            if h is not None:
                seen[key].append(h)
    return out


@pytest.mark.parametrize("most, edges", [(20_000, 10**6), (5, 10**6), (0, 3)])
def test_greedy_in_rounds_equals_the_fold(spark, most, edges):
    """Clusters, chains of drifting hashes and lone items; large keys in sweeps, pairs and rounds."""
    rng = random.Random(8)
    rows, at = [], 0
    for key in (1, 2, None):
        centres = [rng.getrandbits(64) - (1 << 63) for _ in range(4)]
        drift = rng.getrandbits(62)
        for k in range(60):
            drift ^= 1 << rng.randrange(62)
            for h in (rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(63), rng.choice([0, 1, 3, 6]))), drift ^ (1 << rng.randrange(62)), rng.getrandbits(63) if k % 5 == 0 else None):
                rows.append((key, at, h))
                at += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "video_id long, idx int, h long").repartition(3)
    got = select.greedy(df, ["video_id"], ["idx"], "h", 6, most=most, edges=edges)
    assert {(r.video_id, r.idx) for r in got.collect() if r.kept} == plain_greedy(rows) and got.count() == len(rows)
    one = select.greedy(df, [], ["idx"], "h", 6, most=most, edges=edges)
    assert {r.idx for r in one.collect() if r.kept} == {at for _, at in plain_greedy([(0, a, h) for _, a, h in rows])}


def test_greedy_of_a_static_recording(spark):
    """100,000 equal hashes of one key, and as many near another one: rows stay linear in the items."""
    n, centre = 100_000, (1 << 62) + 77
    noise = "case when id % 2 = 0 then 0L else shiftleft(1L, cast(id % 60 as int)) ^ shiftleft(1L, cast(floor(id / 60) % 60 as int)) end"
    items = spark.range(2 * n).selectExpr("1L video_id", "id idx", f"case when id < {n} then 77L else {centre}L ^ {noise} end h")
    first = {}
    for r in items.collect():
        first.setdefault(r.h, r.idx)
    want = plain_greedy([(1, idx, h) for h, idx in first.items()], 2)
    for most in (20_000, 100):
        got = select.greedy(items, ["video_id"], ["idx"], "h", 2, most=most)
        assert {(1, r.idx) for r in got.where("kept").collect()} == want


def plain_match(canvas, band, every):
    b = band - band.mean()
    best = -1.0
    for y in range(0, len(canvas) - len(band) + 1, every):
        part = canvas[y : y + len(band)] - canvas[y : y + len(band)].mean()
        if part.any():
            best = max(best, float((b * part).sum() / np.sqrt((b * b).sum() * (part * part).sum())))
    return best


def test_band_match_by_transform():
    """Eight bands of a canvas of 4,736 rows, true ones and strange ones, against the loop over its rows."""
    rng = np.random.default_rng(21)
    canvas = np.kron(rng.integers(0, 256, (592, 24)), np.ones((8, 2))).astype(np.uint8)
    canvas[700:1100] = 255  # rows without contrast
    for k in range(8):
        band = canvas[k * 590 : k * 590 + 60].astype(np.float64)
        if k % 2:
            band = np.clip(band + rng.normal(0, 40, band.shape), 0, 255)
        band = band.astype(np.uint8)
        for every in (1, 7):
            assert stitch.best_match(canvas, band, every, columns=20) == pytest.approx(plain_match(canvas.astype(np.float64), band.astype(np.float64), every), abs=1e-9)
    assert stitch.best_match(canvas, canvas[800:860]) == 1.0 and stitch.best_match(canvas[:10], canvas[:20]) == -1.0


def test_automatic_header_over_tasks(spark):
    """Segments spread over tasks begin with the estimates that one pass in order carries to them; the result is the serial one."""
    rng = np.random.default_rng(22)
    rows, want, heights = [], {}, {1: [30, 30, 30, 30], 2: [48, 30, 60, 30, 24, 30]}
    for video, tops in heights.items():
        header, idx = stitch.Header(auto=True), 0
        for seg, fixed in enumerate(tops):
            page, top = rng.integers(0, 256, (500, 64)).astype(np.uint8), np.full((fixed, 64), 90, np.uint8)
            moves = (0, 0, 0) if seg == 1 else (0, 9, 9, 25, 50)  # a segment that doesn't scroll teaches nothing
            grays = []
            for y in moves:
                gray = np.concatenate([np.zeros((11, 64), np.uint8), top, page[y : y + 189 - fixed]])
                rows.append((video, idx, 64, 200, 3, np.repeat(gray[:, :, None], 3, axis=2).tobytes(), seg))
                grays.append(pixels.gray_cv(images.rgb(rows[-1][5], 200, 64, 3))[11:])
                idx += 1
            begins = (video, seg, header.rows, header.known)
            made = list(stitch.decisions(grays, header))
            want[video, seg] = (*begins, sum(d["accepted"] and d["reason"] is None for d in made), sum(d["add_rows"] for d in made))
    frames = spark.createDataFrame([r[:6] for r in rows], images.PIXELS).repartition(4)
    seg = spark.createDataFrame([(r[0], r[1], "detail", r[6]) for r in rows], "video_id long, idx int, cat string, seg int")
    joined = frames.join(seg.drop("cat"), ["video_id", "idx"])
    got = {(r.video_id, r.seg): tuple(r) for r in recordings.headers(joined).collect()}
    assert got == {k: w[:4] for k, w in want.items()}
    assert len({w[2:4] for w in want.values()}) >= 4
    out = {(r.video_id, r.seg): r for r in recordings.stitched(frames, seg, auto=True).collect()}
    assert {k: r.accepted for k, r in out.items()} == {k: w[4] for k, w in want.items()}
    assert all(r.height == want[k][5] for k, r in out.items() if r.accepted)


def test_counters_in_passing(spark, sf_dir, tmp_path):
    """The counters of a written table are those of the counting query, and writing stays one pass over the frames."""
    stable = select.stability(fr.segments(B.frames(spark, sf_dir)))
    rows, seen = fr.counted(stable)
    group = f"g{random.getrandbits(40)}"
    spark.sparkContext.setJobGroup(group, "counted")
    rows.write.parquet(str(tmp_path / "out"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    alone = f"g{random.getrandbits(40)}"
    spark.sparkContext.setJobGroup(alone, "plain")
    stable.write.parquet(str(tmp_path / "plain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    assert len(jobs(group)) == len(jobs(alone))
    by_video = queries.a5_counters(spark, sf_dir).agg(F.sum("frames").alias("frames"), F.sum("details").alias("details"), F.sum("stable").alias("stable"), F.max("last_frame").alias("last_frame")).first()
    assert seen.get == by_video.asDict()

