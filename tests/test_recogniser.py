"""Recognisers that hang, die, fail or start slowly cost one attempt each."""

from __future__ import annotations

import os
import time

import pytest

from sparkreel.operators import ocr, recogniser


def engine():
    """Answers with the image's own text; some images do harm."""
    asked = [0]

    def recognise(image: bytes, mode: str) -> str:
        asked[0] += 1
        if image == b"hang":
            time.sleep(600)
        if image == b"die":
            os._exit(3)
        if image == b"raise":
            raise ValueError("unreadable")
        if image == b"count":
            return f"{asked[0]} {os.getpid()}"
        print("noise on the standard output")
        return f"{image.decode()}{'' if mode == 'timestamp' else ' | ' + mode}"

    return recognise


def test_a_session_replaces_what_fails():
    session = recogniser.Session(engine, 30, 1)
    try:
        assert session.recognise(b"2026-08-25 22:59", "timestamp") == "2026-08-25 22:59"
        n, first = session.recognise(b"count", "timestamp").split()
        assert n == "2"  # the same child
        for bad in (b"hang", b"die", b"raise"):
            began = time.monotonic()
            with pytest.raises(recogniser.Failed):
                session.recognise(bad, "timestamp")
            assert time.monotonic() - began < 10
            n, now = session.recognise(b"count", "timestamp").split()
            assert n == "1" and now != first  # a new one
            first = now
            with pytest.raises(ProcessLookupError):
                os.kill(int(first) if session.close() is None else 0, 0)
        assert session.recognise(b"x" * 300_000, "timestamp") == "x" * 300_000
    finally:
        session.close()


def test_starts_that_fail():
    def slow():
        time.sleep(600)

    def broken():
        raise OSError("no model")

    for make, text in ((slow, "in time"), (broken, "no model")):
        session = recogniser.Session(make, 1, 1)
        for _ in range(2):
            with pytest.raises(recogniser.Failed, match=text):
                session.recognise(b"a", "timestamp")
        assert session.child is None


def test_attempts_with_a_hanging_recogniser(spark):
    """The image that hangs is one failed attempt; its segment goes on to the next."""
    rows = [(1, 0, 3, 1, b"hang", b"a"), (1, 0, 6, 2, b"2026-08-25 22:59", b"Yuki"), (1, 0, 9, 3, b"2026-08-25 23:00", b"late"), (1, 1, 12, 1, b"nothing", b"hang"), (1, 1, 15, 2, b"2026-08-26 01:02", b"die"), (2, 0, 0, 1, None, None)]
    crops = spark.createDataFrame(rows, "video_id long, seg int, idx int, attempt int, timestamp_png binary, sender_png binary").coalesce(1)
    got = {(r.video_id, r.seg, r.attempt): r for r in recogniser.recognise(crops, engine, image_s=1.0).collect()}
    assert len(got) == 6
    assert got[1, 0, 1].error and got[1, 0, 1].timestamp is None
    assert (got[1, 0, 2].timestamp, got[1, 0, 2].sender, got[1, 0, 2].error) == ("2026-08-25_2259", "Yuki sender", False)
    assert not got[1, 1, 1].error and got[1, 1, 1].raw_sender is None  # without a time stamp nobody asks for the sender
    assert got[1, 1, 2].error and got[1, 1, 2].timestamp is None
    assert not got[2, 0, 1].error
    made = spark.createDataFrame([tuple(r[c] for c in ("video_id", "seg", "idx", "attempt", "timestamp", "error")) for r in got.values()], "video_id long, seg int, idx int, attempt int, timestamp string, error boolean")
    runs = sorted((r.video_id, r.seg, r.attempt) for r in ocr.outcomes(made).collect())
    assert runs == [(1, 0, 1), (1, 0, 2), (1, 1, 1), (1, 1, 2), (2, 0, 1)]
