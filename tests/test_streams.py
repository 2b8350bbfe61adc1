"""Streams against the batch operators or a plain loop."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from sparkreel.functions import pixels, stitch
from sparkreel.operators import select
from sparkreel.operators.ocr import Waiting
from sparkreel.sources import images
from sparkreel.streaming import events
from sparkreel.streaming import frames as streams
from tests.test_frames import run_stream


def fill(w, segments, each, gap=10):
    for seg in range(segments):
        for k in range(each):
            w.offer(seg, k * gap)


def waiting(w, seg):
    return [r[1] for r in w.rows if r[0] == seg]


def test_waiting_frames():
    w = Waiting()
    assert [w.offer(0, k) for k in (10, 11, 13)] == [True, False, True]
    w = Waiting(attempts=2)
    assert w.offer(0, 0) and not w.admits(0, 1) and w.admits(0, 3) and w.offer(0, 3) and not w.admits(0, 6) and w.admits(1, 0)
    w = Waiting()
    assert sum(w.offer(0, k) for k in range(30)) == 8 and w.take()[:2] == (0, 0)
    assert not w.admits(0, 60)  # tries and waiting frames count together
    w.told(0, True)
    assert not w.rows and not w.offer(0, 900)


def test_places_are_shared_fairly():
    w = Waiting(attempts=3, total=4, spacing=1)
    assert [w.offer(0, k) for k in range(4)] == [True, True, True, False]
    w.take()
    assert w.offer(1, 0) and w.offer(1, 1) and len(w.rows) == 4
    assert w.offer(2, 0) and len(w.rows) == 4 and waiting(w, 0) == [1]
    assert not w.offer(1, 2)
    assert sum(s.dropped for s in w.segments.values()) == 3
    for segments in (20, 21, 60, 64, 65, 100):
        w = Waiting(spacing=1)
        fill(w, segments, 8)
        least = min(len(waiting(w, k)) for k in range(segments))
        assert len(w.rows) <= 64 and least >= (3 if segments <= 21 else 1 if segments <= 64 else 0)
        assert waiting(w, segments - 1)[0] == 0
        if segments == 20:
            assert waiting(w, 0)[0] == 0 and waiting(w, 0)[-1] == 70
            assert [r[1] for r in w.rows if r[0] == 5] == sorted(waiting(w, 5))


def test_failures_in_a_row_stop_the_video():
    w = Waiting(spacing=1, errors=2)
    fill(w, 2, 2, 1)
    for error in (True, False, True):
        w.told(w.take()[0], False, error)
    assert not w.stopped
    w.told(w.take()[0], False, True)
    assert w.stopped and not w.rows and not w.offer(5, 0) and w.take() is None


def test_stream_of_recognition(spark, tmp_path):
    """Segments stop at their first time stamp, in later batches too; nobody crops what is refused."""
    rows = [(v, seg, k * 3, f"{v}-{seg}-{k}".encode(), False) for v in (1, 2) for seg in range(3) for k in range(5)]
    rows.sort(key=lambda r: (r[1], r[2]))
    rows += [(v, 9, 0, b"", True) for v in (1, 2)]

    def recognise(crop):
        v, seg, k = map(int, crop.split(b"-"))
        if (v, seg) == (2, 2):
            raise RuntimeError("no answer")
        return ("2026-01-01_0000", "x") if k == seg + 1 else (None, None)

    got = run_stream(spark, rows, "video_id long, seg int, idx int, crop binary, end boolean", lambda s: streams.recognition(s, recognise, per_batch=4), tmp_path, 4)
    tries = {}
    for v, seg, idx, attempt, stamp, _, error in sorted(got):
        assert attempt == idx // 3 + 1
        tries.setdefault((v, seg), []).append("e" if error else "y" if stamp else "n")
    assert {k: "".join(t) for k, t in tries.items()} == {(1, 0): "ny", (1, 1): "nny", (1, 2): "nnny", (2, 0): "ny", (2, 1): "nny", (2, 2): "eee"}


def test_stream_of_selection(spark, tmp_path):
    rng, rows = random.Random(3), []
    base = [rng.getrandbits(62) for _ in range(6)]
    for v in range(3):
        for k in range(90):
            cat = rng.choice(["detail", "detail", "fullscreen_image", "list"])
            h = rng.choice(base[:2] if cat == "detail" else base[2:]) ^ (1 << rng.randrange(40))
            rows.append((v, k // 15, k, cat, round(rng.random(), 3), h, False))
    schema = "video_id long, seg int, idx int, cat string, bm double, h long, end boolean"
    stream = sorted(rows, key=lambda r: r[2]) + [(v, 0, 0, None, None, None, True) for v in range(3)]
    got = run_stream(spark, stream, schema, streams.select, tmp_path, 5)
    want = select.select_events_held(select.stability(spark.createDataFrame(rows, schema)))
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in want.collect())
    # the batch rule itself, frame by frame
    near = lambda a, b, d: (a ^ b).bit_count() <= d
    for v in range(3):
        seen, plain = [], []
        for seg in range(6):
            last, mail, held, over = {}, None, [], []
            for _, _, idx, cat, bm, h, _ in [r for r in rows if r[0] == v and r[1] == seg]:
                stable = cat in last and near(h, last[cat], 2)
                last[cat] = h
                if cat == "detail" and (mail is None or (stable, bm) > mail[:2]):
                    mail = (stable, bm, idx, h)
                if cat == "fullscreen_image" and stable and not any(near(h, x, 6) for x in seen) and not any(near(h, x[1], 6) for x in held):
                    (held if len(held) < 4 else over).append((idx, h))
            for kind, idx, h in [("mail", *mail[2:])] * (mail is not None) + [("image", *x) for x in held]:
                dup = any(near(h, x, 6) for x in seen)
                seen += [] if dup else [h]
                plain.append((seg, kind, idx, "skipped" if dup else "selected"))
            plain += [(seg, "image", idx, "skipped") for idx, _ in over]
        assert sorted(plain) == sorted((r[1], r[2], r[3], r[7]) for r in got if r[0] == v)


def test_stream_of_stitching(spark, tmp_path):
    """State goes over micro-batches; a new segment starts anew, the header is carried on."""
    frames = images.synthetic(spark, mails=2).collect()
    detail = [r for r in frames if pixels.metrics(images.rgb(r.data, r.height, r.width, r.n_channels))[0] >= 0.15]
    half = len(detail) // 2
    rows = [(7, int(k >= half), r.idx, r.width, r.height, r.n_channels, bytes(r.data), False) for k, r in enumerate(detail)] + [(7, 9, 0, 0, 0, 0, b"", True)]
    schema = "video_id long, seg int, idx int, width int, height int, n_channels int, data binary, end boolean"
    got = sorted(run_stream(spark, rows, schema, lambda s: streams.stitch(s, auto=True), tmp_path, 6))
    header, want = stitch.Header(auto=True), []
    for seg in (0, 1):
        mine = [r for k, r in enumerate(detail) if int(k >= half) == seg]
        grays = [pixels.gray_cv(images.rgb(r.data, r.height, r.width, r.n_channels)[int(r.height * 0.055) :]) for r in mine]
        placed = 0
        for r, d in zip(mine, stitch.decisions(grays, header), strict=True):
            want.append((7, seg, r.idx, d["i"], d["accepted"], d["reason"], d["add_rows"], placed, d["skip"]))
            placed += d["add_rows"]
    assert [(*r[:4], *r[7:]) for r in got] == want and sum(r[7] for r in got) > 6


def test_events_carry_their_job(spark, tmp_path):
    progress = events.Progress()
    spark.streams.addListener(progress)
    try:
        for job, n in (("job-1", 3), ("job-2", 5)):
            spark.range(n).withColumn("job_id", F.lit("stale")).coalesce(1).write.parquet(str(tmp_path / job))
            stream = spark.readStream.schema("id long, job_id string").parquet(str(tmp_path / job))
            for _ in range(2):  # a restart writes nothing twice
                q = events.sink(stream, job, str(tmp_path / "events"), str(tmp_path / f"state-{job}"))
                q.awaitTermination(120)
                assert q.exception() is None
        got = spark.read.parquet(str(tmp_path / "events")).groupBy("job_id").count().collect()
        assert {r.job_id: r["count"] for r in got} == {"job-1": 3, "job-2": 5}
        for _ in range(100):
            if sum(r[1] == "finished" for r in progress.rows()) >= 4:
                break
            import time

            time.sleep(0.1)
        seen = {r[0] for r in progress.rows()}
        assert seen == {"job-1", "job-2"} and max(r[3] for r in progress.rows() if r[0] == "job-2" and r[1] == "progress") == 5
    finally:
        spark.streams.removeListener(progress)


def run_live(spark, batches, schema, op, tmp_path):
    """Batches one by one under one running query, until each has been read; then time passes until the timers have fired."""
    folder, name = tmp_path / "live", f"l{random.getrandbits(40)}"
    folder.mkdir()
    source = spark.readStream.schema(schema).parquet(str(folder / "*"))
    q = op(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "live-state")).trigger(processingTime="200 milliseconds").start()
    states = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

    def until(done, seconds=40):
        end = time.time() + seconds
        while not done() and time.time() < end:
            assert q.exception() is None
            time.sleep(0.1)
        assert done()

    try:
        seen, total = [], 0
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b={k}"))
            total += len(rows)
            until(lambda: sum(p["numInputRows"] for p in q.recentProgress) >= total)
            seen.append(len(spark.table(name).collect()))
        until(lambda: states()[-1] == 0)
        time.sleep(1)
        return seen, [tuple(r) for r in spark.table(name).collect()], states()[-1]
    finally:
        q.stop()


def test_a_silent_video_is_flushed_once(spark, tmp_path):
    """No end row: after the silence the held frame comes out, the state is gone, and a later frame starts anew."""
    schema = "video_id long, n long, ts_us long, dur_us long, end boolean"
    batches = [[(1, k, k * 500_000, 500_000, False) for k in range(3)], [(2, 0, 7_000_000, 1_000_000, False)]]
    seen, got, left = run_live(spark, batches, schema, lambda s: streams.sample(s, silence_ms=6000), tmp_path)
    assert seen[0] == 6 and left == 0  # two frames of three slots each; the third is held
    assert sorted(got) == [(1, slot, slot // 3) for slot in range(9)] + [(2, slot, 0) for slot in range(6)]


def test_a_silent_segment_is_closed_once(spark, tmp_path):
    schema = "video_id long, seg int, idx int, cat string, bm double, h long, end boolean"
    batches = [[(1, 0, 0, "detail", 0.5, 7, False), (1, 0, 1, "detail", 0.6, 7, False)], [(1, 1, 2, "detail", 0.5, 7, False)]]
    seen, got, left = run_live(spark, batches, schema, lambda s: streams.select(s, silence_ms=6000), tmp_path)
    assert seen == [0, 1] and left == 0
    assert [(r[1], r[3], r[7]) for r in sorted(got)] == [(0, 1, "selected"), (1, 2, "skipped")]


def test_an_index_asks_for_a_fixed_number_of_cells():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    rng = random.Random(11)
    index = select.HashIndex(6, Counted())
    held, costs = [], []
    for k in range(3000):
        h = rng.getrandbits(64) - (1 << 63) if k % 3 else rng.choice(held or [0]) ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(10)))
        near = any(((h ^ x) & (1 << 64) - 1).bit_count() <= 6 for x in held)
        index.cells.asked = 0
        assert index.near(h) == near
        costs.append(index.cells.asked)
        if not near:
            held.append(h)
            index.add(h)
    assert max(costs) == 4 * 17 and len(held) > 1500 and max(map(len, index.cells.values())) < 12

