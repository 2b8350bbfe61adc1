"""MP4 containers: top-level boxes, the video track and its samples, as tables.

`Mp4` is a data source over files of any size, in a folder or one by one: a file is split into runs of samples by its length
alone, each run is a partition, and a task finds the sample tables by seeking from box to box and
reads no more of them than its run needs (sizes and chunk places by range, run-length tables block by block).
The media data is read only on request, sample by sample. Files are opened inside the tasks by pyarrow,
so the executors must see them. scan_boxes() and demux() do the same for files that are
a binary column already. Decoding compressed video needs a codec, which is not part of this library; frames come as
images.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import constants as K
from ..schemas import BOXES

_CONFIG = {"avcC": "avc", "hvcC": "hevc", "vpcC": "vp", "av1C": "av1"}
#: Entries of a run-length table read at once; samples of a batch; bytes of media in a batch; bytes of a file in a partition.
_ENTRIES, _SAMPLES, _MEDIA, _SPLIT = 1 << 16, 1 << 14, 8 << 20, 256 << 20


def _read(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) < n:
        raise ValueError(f"{n} bytes at {at} are cut off")
    return got


def walk(f: BinaryIO, start: int, end: int) -> Iterator[tuple[int, str, int, int, int]]:
    """(ordinal, type, offset, size, header size) of the boxes between two places, by seeking. A size of 1 means a
    64-bit size follows, 0 means to the end; a size below the header is an error."""
    at, i = start, 0
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", _read(f, at, 8))
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError(f"box at {at} is cut off")
            size, head = struct.unpack(">Q", _read(f, at + 8, 8))[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            raise ValueError(f"box at {at} has size {size}")
        yield i, kind.decode("latin-1"), at, size, head
        at += size
        i += 1


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, str, int, int]]:
    """(ordinal, type, offset, size) of the boxes in data[start:end]."""
    for i, kind, at, size, _ in walk(io.BytesIO(data), start, len(data) if end is None else end):
        yield i, kind, at, size


class _Boxes:
    def eval(self, content):
        yield from boxes(bytes(content or b""))


def scan_boxes(files: DataFrame, content: str = "content") -> DataFrame:
    """files with one row per top-level box: i, type, offset, size."""
    return files.lateralJoin(F.udtf(_Boxes, returnType=BOXES)(F.col(content).outer()))


def _find(f: BinaryIO, path: list[str], start: int, end: int) -> Iterator[tuple[int, int]]:
    """Contents (from, to) of the boxes at a path."""
    for _, kind, at, size, head in walk(f, start, end):
        if kind == path[0]:
            inner = at + head, min(at + size, end)
            if len(path) == 1:
                yield inner
            else:
                yield from _find(f, path[1:], *inner)


#: Bytes of a visual sample entry before the boxes inside it, its own header included.
_ENTRY_HEAD = 86


def description(stsd: bytes) -> tuple[str | None, bytes | None]:
    """(codec, decoder configuration) of the first visual sample entry of a sample description (without its
    box header) that holds a known configuration box: that box's content."""
    for _, _, at, size in boxes(stsd, 8):
        for _, kind, inner, n in boxes(stsd, at + _ENTRY_HEAD, at + size):
            if kind in _CONFIG:
                return _CONFIG[kind], stsd[inner + 8 : inner + n]
    return None, None


@dataclass
class Track:
    """The first video track of a file: where its tables are, and how many samples they name."""

    timescale: int
    duration: int
    codec: str | None
    description: bytes | None
    tables: dict[str, tuple[int, int]] = field(default_factory=dict)
    count: int = 0
    fixed_size: int = 0

    def _entries(self, f: BinaryIO, kind: str) -> tuple[int, int]:
        """(place of the first entry, number of entries) of a table; none if it is missing."""
        if kind not in self.tables:
            return 0, 0
        at = self.tables[kind][0]
        return at + 8, struct.unpack(">I", _read(f, at + 4, 4))[0]

    def _part(self, f: BinaryIO, kind: str, dtype: str, first: int, last: int, width: int = 1) -> np.ndarray:
        at, n = self._entries(f, kind)
        first, last = min(first, n), min(last, n)
        size = np.dtype(dtype).itemsize * width
        return np.frombuffer(_read(f, at + first * size, (last - first) * size), dtype).astype(np.int64).reshape(-1, width)

    def _expanded(self, f: BinaryIO, kind: str, value: str, first: int, last: int) -> tuple[np.ndarray, int]:
        """A run-length table's values of samples first .. last, and the sum of those before."""
        _, n = self._entries(f, kind)
        got, base, before = [np.zeros(0, np.int64)], 0, 0
        for k in range(0, n, _ENTRIES):
            counts, values = self._part(f, kind, ">u4", k, k + _ENTRIES, 2).T
            if value == "signed":
                values = values.astype(np.uint32).view(np.int32).astype(np.int64)
            starts = before + np.cumsum(counts) - counts
            low, high = np.clip(first - starts, 0, counts), np.clip(last - starts, 0, counts)
            base += int((low * values).sum())
            got.append(np.repeat(values, high - low))
            before += int(counts.sum())
            if before >= last:
                break
        return np.concatenate(got), base

    def samples(self, f: BinaryIO, first: int, last: int) -> dict[str, np.ndarray]:
        """number, cts, duration, is_sync, offset and size of samples first .. last (from 0)."""
        last = min(last, self.count)
        chunks = "stco" if "stco" in self.tables else "co64"
        total_chunks = self._entries(f, chunks)[1]
        _, n_runs = self._entries(f, "stsc")
        runs = self._part(f, "stsc", ">u4", 0, n_runs, 3)
        runs = runs[runs[:, 0] <= total_chunks]
        if not len(runs) or first >= last:
            return {k: np.zeros(0, np.int64) for k in ("number", "cts", "duration", "is_sync", "offset", "size")}
        per = runs[:, 1]
        held = (np.append(runs[1:, 0], total_chunks + 1) - runs[:, 0]) * per
        starts = np.cumsum(held) - held  # first sample of each run of chunks
        last = min(last, int(held.sum()))

        def chunk_of(sample: np.ndarray) -> np.ndarray:
            r = np.searchsorted(starts, sample, "right") - 1
            return runs[r, 0] - 1 + (sample - starts[r]) // per[r]

        def start_of(chunk: np.ndarray) -> np.ndarray:
            r = np.searchsorted(runs[:, 0] - 1, chunk, "right") - 1
            return starts[r] + (chunk - runs[r, 0] + 1) * per[r]

        if first >= last:
            return self.samples(f, 0, 0)
        begin = int(start_of(chunk_of(np.array([first])))[0])
        index = np.arange(begin, last)
        if self.fixed_size:
            size = np.full(len(index), self.fixed_size, np.int64)
        else:
            at = self.tables["stsz"][0] + 12
            size = np.frombuffer(_read(f, at + 4 * begin, 4 * len(index)), ">u4").astype(np.int64)
        ahead = np.cumsum(size) - size
        chunk = chunk_of(index)
        places = self._part(f, chunks, ">u4" if chunks == "stco" else ">u8", int(chunk[0]), int(chunk[-1]) + 1)[:, 0]
        offset = places[chunk - chunk[0]] + ahead - ahead[start_of(chunk) - begin]
        mine = slice(first - begin, None)
        duration, dts = self._expanded(f, "stts", "plain", first, last)
        if len(duration) < last - first:
            raise ValueError("the time table is too short")
        shift, _ = self._expanded(f, "ctts", "signed", first, last)
        shift = np.append(shift, np.zeros(last - first - len(shift), np.int64))
        number = index[mine] + 1
        sync = np.ones(len(number), bool)
        if "stss" in self.tables:
            _, n = self._entries(f, "stss")
            sync[:] = False
            for k in range(0, n, _ENTRIES):
                keys = self._part(f, "stss", ">u4", k, k + _ENTRIES)[:, 0]
                sync |= np.isin(number, keys)
        return {"number": number, "cts": dts + np.cumsum(duration) - duration + shift, "duration": duration, "is_sync": sync, "offset": offset[mine], "size": size[mine]}


def open_track(f: BinaryIO, size: int) -> Track:
    """The first video track of a file. Errors name what is missing."""
    moov = next(((at + head, min(at + n, size)) for _, kind, at, n, head in walk(f, 0, size) if kind == "moov"), None)
    if moov is None:
        raise ValueError("no moov box")
    for a, b in _find(f, ["trak"], *moov):
        hdlr = next(_find(f, ["mdia", "hdlr"], a, b), None)
        if hdlr is None or _read(f, hdlr[0] + 8, 4) != b"vide":
            continue
        m = next(_find(f, ["mdia", "mdhd"], a, b), None)
        tables = next(_find(f, ["mdia", "minf", "stbl"], a, b), None)
        if m is None or tables is None:
            raise ValueError("the video track lacks its header or its tables")
        scale, duration = struct.unpack(">II", _read(f, m[0] + 12, 8)) if _read(f, m[0], 1) == b"\0" else struct.unpack(">IQ", _read(f, m[0] + 20, 12))
        stbl = {kind: (at + head, at + n) for _, kind, at, n, head in walk(f, *tables)}
        codec, config = description(_read(f, stbl["stsd"][0], stbl["stsd"][1] - stbl["stsd"][0])) if "stsd" in stbl else (None, None)
        out = Track(scale, duration, codec, config, stbl)
        if "stsz" in stbl:
            out.fixed_size, out.count = struct.unpack(">II", _read(f, stbl["stsz"][0] + 4, 8))
        return out
    raise ValueError("no video track")


def track(data: bytes) -> dict:
    """The first video track: timescale, duration, codec, description and its samples
    (number, cts, duration, is_sync, offset, size)."""
    f = io.BytesIO(data)
    t = open_track(f, len(data))
    columns = t.samples(f, 0, t.count)
    return {"timescale": t.timescale, "duration": t.duration, "codec": t.codec, "description": t.description, "samples": list(zip(*(c.tolist() for c in columns.values()), strict=True))}


SAMPLES = "path string, codec string, timescale long, number long, cts long, duration long, is_sync boolean, offset long, size long, error string"


def demux(files: DataFrame) -> DataFrame:
    """One row per sample of each file's first video track; files that cannot be read give one row with the error."""

    def run(stream):
        import pandas as pd

        cols = [c.split()[0] for c in SAMPLES.split(", ")]
        for pdf in stream:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    t = track(content)
                    rows += [(path, t["codec"], t["timescale"], *s, None) for s in t["samples"]]
                except (ValueError, KeyError, struct.error) as e:
                    rows.append((path, None, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=cols).astype({c: "Int64" for c in ("timescale", "number", "cts", "duration", "offset", "size")} | {"is_sync": "boolean"})

    return files.select("path", "content").mapInPandas(run, SAMPLES)


def videos(spark: SparkSession, folder: str) -> DataFrame:
    """Video files of a folder (by extension), as (path, modificationTime, length, content). Empty files give no row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{mp4,MP4,mov,MOV,m4v,M4V}").load(folder)


@dataclass
class _Run(InputPartition):
    """Part k of n equal runs of a file's samples."""

    path: str
    size: int
    k: int
    n: int


def _filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (arrow_fs.LocalFileSystem(), path)


class Mp4Reader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema):
        self.path, self.schema = options["path"], schema
        self.split, self.media = int(options.get("bytesperpartition", _SPLIT)), options.get("media", "false").lower() == "true"

    def partitions(self) -> list[_Run]:
        """By the files' lengths alone: nothing is opened for it."""
        system, path = _filesystem(self.path)
        info = system.get_file_info(path)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [i for i in system.get_file_info(arrow_fs.FileSelector(path, recursive=True)) if i.is_file and re.search(K.VIDEO_FILE, i.path)]
        out = []
        for i in sorted(found, key=lambda i: i.path):
            n = max(1, -(-i.size // self.split))
            out += [_Run(i.path, i.size, k, n) for k in range(n)]
        return out

    def read(self, run: _Run) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        try:
            with system.open_input_file(run.path) as f:
                t = open_track(f, run.size)
                first, last = t.count * run.k // run.n, t.count * (run.k + 1) // run.n
                for a in range(first, last, _SAMPLES):
                    columns = t.samples(f, a, min(a + _SAMPLES, last))
                    yield from self._batches(run, t, columns, f)
        except (ValueError, KeyError, struct.error) as e:
            if run.k == 0:
                yield self._batch([run.path], error=[str(e)])

    def _batches(self, run: _Run, t: Track, columns: dict[str, np.ndarray], f: BinaryIO) -> Iterator[pa.RecordBatch]:
        n, a = len(columns["number"]), 0
        weight = np.cumsum(columns["size"])
        while a < n:
            done = int(weight[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(weight, done + _MEDIA, "right"))) if self.media else n
            part = {k: v[a:b] for k, v in columns.items()}
            if self.media:
                part["data"] = [_read(f, int(at), int(size)) for at, size in zip(part["offset"], part["size"], strict=True)]
            yield self._batch([run.path] * (b - a), codec=[t.codec] * (b - a), description=[t.description] * (b - a), timescale=[t.timescale] * (b - a), **part)
            a = b

    def _batch(self, path: list[str], **columns) -> pa.RecordBatch:
        columns["path"] = path
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(path)), f.type) for f in self.schema], schema=self.schema)


class Mp4(DataSource):
    """spark.read.format("mp4").load(folder or file): one row per sample of each file's first video track.

    Options: bytesPerPartition, and media ("true": a column `data` with the samples' bytes). Files
    that can't be read give one row with the error.
    """

    @classmethod
    def name(cls) -> str:
        return "mp4"

    def schema(self) -> str:
        return SAMPLES.replace("timescale", "description binary, timescale") + (", data binary" if self.options.get("media", "false").lower() == "true" else "")

    def reader(self, schema) -> Mp4Reader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return Mp4Reader(dict(self.options), to_arrow_schema(schema))


def samples(spark: SparkSession, path: str, media: bool = False, bytes_per_partition: int = _SPLIT) -> DataFrame:
    """The samples of a folder's videos, or of one video of any size."""
    spark.dataSource.register(Mp4)
    return spark.read.format("mp4").option("media", str(media).lower()).option("bytesPerPartition", str(bytes_per_partition)).load(path)
