"""Frames as images: reading folders of them, and writing PNG files and ZIP archives."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.cluster import qualified
from ..schemas import PIXELS


def read_frames(spark: SparkSession, folder: str, video_id: int = 0) -> DataFrame:
    """Images named <anything>_<number>.png as frames: (video_id, idx, width, height, n_channels, data).

    idx is the number less one, so it follows the sorted names. data is in the image source's
    order, which is blue, green, red.
    """
    im = spark.read.format("image").option("dropInvalid", True).load(folder)
    idx = F.regexp_extract("image.origin", r"_(\d+)\.png$", 1).cast("int") - 1
    return im.select(F.lit(video_id).cast("long").alias("video_id"), idx.alias("idx"), "image.width", "image.height", F.col("image.nChannels").alias("n_channels"), "image.data")


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(h, w, 3) red, green, blue view of the bytes of a frame."""
    a = np.frombuffer(data, np.uint8)
    if len(a) != height * width * channels:
        raise ValueError(f"{len(a)} bytes for {height} x {width} x {channels}")
    a = a.reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def png(img: np.ndarray) -> bytes:
    """A gray (h, w) or colour (h, w, 3) image as a PNG file."""
    h, w = img.shape[:2]
    colour = 2 if img.ndim == 3 else 0
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(img).reshape(h, -1)], axis=1).tobytes()
    return _file(w, h, colour, zlib.compress(raw, 6))


def _file(width: int, height: int, colour: int, body: bytes) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


class TallPng:
    """A colour PNG whose rows come a few at a time; only the compressed image is held."""

    def __init__(self, width: int):
        self.width, self.height, self.z, self.parts = width, 0, zlib.compressobj(6), []

    def add(self, rows: np.ndarray) -> None:
        flat = np.ascontiguousarray(rows).reshape(len(rows), -1)
        self.parts.append(self.z.compress(np.concatenate([np.zeros((len(flat), 1), np.uint8), flat], axis=1).tobytes()))
        self.height += len(rows)

    def finish(self) -> bytes:
        return _file(self.width, self.height, 2, b"".join([*self.parts, self.z.flush()]))


def cropped_png(img: np.ndarray, status_bar: float) -> bytes:
    """A frame without its status bar, as PNG."""
    return png(img[int(img.shape[0] * status_bar) :])


def write_pngs(frames: DataFrame, column: str = "png", name: str = "name", folder: str = "") -> DataFrame:
    """Writes a PNG per row under `folder` (any address pyarrow's file systems know); (name, bytes) of each.

    A folder without scheme is where Spark itself would write. Writing happens when the result is
    read; read it once, e.g. into a table.
    """
    at = qualified(frames.sparkSession, folder)

    def run(stream):
        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(at)
        system.create_dir(base, recursive=True)
        for pdf in stream:
            for n, b in zip(pdf[name], pdf[column], strict=True):
                with system.open_output_stream(f"{base}/{n}", compression=None) as out:
                    out.write(b)
            yield pd.DataFrame({"name": pdf[name], "bytes": pdf[column].map(len)})

    return frames.select(name, column).mapInPandas(run, "name string, bytes long")


def zip_archives(files: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(video_id, archive name, content): one ZIP per video of files (video_id, source_video, seq, name, content).

    metadata: (video_id, metadata), whose text each archive holds as metadata.json after the images.
    A video's exported images are one group; that is the unit a person downloads.
    """
    texts = files.sparkSession.createDataFrame([], "video_id long, metadata string") if metadata is None else metadata.select("video_id", "metadata")
    files = files.join(texts, "video_id", "left")

    def run(pdf):
        import pandas as pd

        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
            for n, c in pdf.sort_values("seq")[["name", "content"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(n), c)
            if pdf["metadata"].iloc[0] is not None:
                z.writestr(zipfile.ZipInfo("metadata.json"), pdf["metadata"].iloc[0])
        stem = pdf["source_video"].iloc[0].rsplit(".", 1)[0]
        return pd.DataFrame({"video_id": [pdf["video_id"].iloc[0]], "archive": [stem + K.ARCHIVE_SUFFIX], "content": [buf.getvalue()]})

    return files.groupBy("video_id").applyInPandas(run, "video_id long, archive string, content binary")


def eased(distance: int, steps: int) -> list[int]:
    """Positions after each step of a flick that slows down to rest (cubic ease-out)."""
    return [round(distance * (1 - (1 - (k + 1) / steps) ** 3)) for k in range(steps)]


def synthetic(spark: SparkSession, height: int = 280, width: int = 129, mails: int = 3, seed: int = 42, video_id: int = 0, truth: dict[int, np.ndarray] | None = None) -> DataFrame:
    """A made-up recording: for each mail some frames of loading, then a page that rests, is flicked twice and rests.

    The result has the schema of read_frames. truth, if given, receives the whole page of each mail
    as far as the recording scrolls, without status bar: what a perfect stitch shows. It serves
    tests and examples, and is small.
    """
    rng = np.random.default_rng(seed)
    rows, idx = [], 0
    tops = [0, 0, 0, *eased(32, 4), 32, *(32 + y for y in eased(28, 4)), 60, 60]

    def add(img):
        nonlocal idx
        rows.append((video_id, idx, width, height, 3, img[:, :, ::-1].astype(np.uint8).tobytes()))
        idx += 1

    for m in range(mails):
        blank = np.full((height, width, 3), 255, np.uint8)
        blank[int(height * 0.145) : int(height * 0.19), int(width * 0.06) : int(width * 0.15)] = (200, 40 + 20 * m, 40)
        for _ in range(2):
            add(blank)
        page = np.full((height * 2, width, 3), 255, np.uint8)
        for top in range(0, height * 2 - 8, 8):
            n = int(rng.integers(width // 3, width))
            page[top + 2 : top + 6, :n] = rng.integers(0, 160, (4, n, 1))
        header = blank[: int(height * 0.25)].copy()
        for y in tops:
            img = np.concatenate([header, page[y : y + height - len(header)]])
            add(img)
        if truth is not None:
            truth[m] = np.concatenate([header, page[: height - len(header) + tops[-1]]])[int(height * K.STATUS_BAR) :]
    return spark.createDataFrame(rows, PIXELS)
