"""Text recognition by a child process of each task, with limits for its start and for each image.

A recogniser is the caller's: `make()` gives a function of (image bytes, mode) that returns text. It runs in a process
of its own, one for each task, as engines hang, leak and crash. What takes longer than its limit, raises or
dies costs that one image: the child is killed, and the next image gets a new one. Images go one after the other.
"""

from __future__ import annotations

import os
import pickle
import select
import struct
import subprocess
import sys
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X

#: Seconds that an engine has to start, and for one image.
START_S, IMAGE_S = 90.0, 60.0

Make = Callable[[], Callable[[bytes, str], str]]


class Failed(RuntimeError):
    """The recogniser did not answer for an image."""


def _send(f, value: object) -> None:
    raw = pickle.dumps(value)
    f.write(struct.pack(">Q", len(raw)) + raw)
    f.flush()


def _receive(f) -> object:
    head = f.read(8)
    if len(head) < 8:
        raise EOFError
    return pickle.loads(f.read(struct.unpack(">Q", head)[0]))


def serve() -> None:
    """The child: builds the recogniser, then answers image by image until its input ends."""
    answers, asks = os.fdopen(os.dup(1), "wb"), os.fdopen(os.dup(0), "rb")
    os.dup2(2, 1)  # what an engine prints is no answer
    try:
        recognise = cloudpickle.loads(_receive(asks))()
        _send(answers, (True, ""))
    except EOFError:
        return
    except Exception as e:
        _send(answers, (False, f"start: {e}"))
        return
    while True:
        try:
            image, mode = _receive(asks)
        except EOFError:
            return
        try:
            _send(answers, (True, recognise(image, mode) or ""))
        except Exception as e:
            _send(answers, (False, f"{type(e).__name__}: {e}"))


class Session:
    """A recogniser in a child process, made when it is first needed and again after each failure."""

    def __init__(self, make: Make, start_s: float = START_S, image_s: float = IMAGE_S):
        self.make, self.start_s, self.image_s, self.child = cloudpickle.dumps(make), start_s, image_s, None

    def _read(self, n: int, until: float) -> bytes:
        out = b""
        fd = self.child.stdout.fileno()
        while len(out) < n:
            left = until - time.monotonic()
            if left <= 0 or not select.select([fd], [], [], left)[0]:
                raise Failed("no answer in time")
            got = os.read(fd, n - len(out))
            if not got:
                raise Failed("the recogniser is gone")
            out += got
        return out

    def _answer(self, seconds: float) -> str:
        until = time.monotonic() + seconds
        ok, text = pickle.loads(self._read(struct.unpack(">Q", self._read(8, until))[0], until))
        if not ok:
            raise Failed(text)
        return text

    def recognise(self, image: bytes, mode: str) -> str:
        """The text of an image; Failed if there is none within the limits."""
        try:
            if self.child is None:
                env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
                self.child = subprocess.Popen([sys.executable, "-c", f"from {__name__} import serve; serve()"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, bufsize=0, env=env)
                _send(self.child.stdin, self.make)
                self._answer(self.start_s)
            _send(self.child.stdin, (image, mode))
            return self._answer(self.image_s)
        except (Failed, OSError, EOFError, pickle.UnpicklingError) as e:
            self.close()
            raise e if isinstance(e, Failed) else Failed(str(e)) from e

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.wait()
            self.child.stdin.close()
            self.child.stdout.close()
            self.child = None


def texts(rows: DataFrame, image: str, mode: str, out: str, make: Make, start_s: float = START_S, image_s: float = IMAGE_S) -> DataFrame:
    """The rows with the text of an image column, and why there is none in `<out>_error`. Null images aren't sent."""
    at = rows.columns.index(image)

    def run(stream):
        session = Session(make, start_s, image_s)
        try:
            for rb in stream:
                found, why = [], []
                for png in rb.column(at).to_pylist():
                    text = error = None
                    if png is not None:
                        try:
                            text = session.recognise(bytes(png), mode)
                        except Failed as e:
                            error = str(e)
                    found.append(text)
                    why.append(error)
                yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(found, pa.string()), pa.array(why, pa.string())], names=[*rb.schema.names, out, f"{out}_error"])
        finally:
            session.close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{out}` string, `{out}_error` string")


def recognise(crops: DataFrame, make: Make, start_s: float = START_S, image_s: float = IMAGE_S) -> DataFrame:
    """(video_id, seg, idx, attempt, timestamp, sender, raw_timestamp, raw_sender, error) of crops: the time stamp of each, and the sender of those that have one.

    A failure of either is a failed attempt.
    """
    first = texts(crops, "timestamp_png", "timestamp", "raw_timestamp", make, start_s, image_s).withColumn("timestamp", X.parse_timestamp(F.col("raw_timestamp")))
    asked = first.select("video_id", "seg", "idx", "attempt", "timestamp", "raw_timestamp", "raw_timestamp_error", F.when(F.col("timestamp").isNotNull(), F.col("sender_png")).alias("sender_png"))
    both = texts(asked, "sender_png", "sender", "raw_sender", make, start_s, image_s)
    error = F.col("raw_timestamp_error").isNotNull() | F.col("raw_sender_error").isNotNull()
    good = lambda c: F.when(~error, c)
    return both.select("video_id", "seg", "idx", "attempt", good(F.col("timestamp")).alias("timestamp"), good(X.clean_sender(F.col("raw_sender"))).alias("sender"), F.trim("raw_timestamp").alias("raw_timestamp"), F.trim("raw_sender").alias("raw_sender"), error.alias("error"))
