"""Exports that commit: PNG files and ZIP archives that stand complete under their names, or not at all.

A job writes into a draft folder beside its target. A task writes each file under a name of its own attempt and moves
it to its place in the draft when it is complete, so a retried or doubled task leaves the same file once
more. When all tasks are done, the draft is moved to the target in one step; if the job fails, it goes.
Folders are addresses that pyarrow's file systems know and all executors see.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.cluster import cut, qualified

WRITTEN = "name string, bytes long, members long"
_ARROW = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())])


class _Draft:
    """A task's place in a draft folder."""

    def __init__(self, at: str):
        self.system, self.base = fs.FileSystem.from_uri(at)
        self.open_name = None
        self.system.create_dir(f"{self.base}/_attempts", recursive=True)

    def open(self) -> pa.NativeFile:
        self.open_name = f"{self.base}/_attempts/{uuid.uuid4().hex}"
        return self.system.open_output_stream(self.open_name, compression=None)

    def finish(self, name: str) -> int:
        """Moves the file to its name; its size."""
        size = self.system.get_file_info(self.open_name).size
        self.system.move(self.open_name, f"{self.base}/{name}")
        self.open_name = None
        return size


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _committed(rows: DataFrame, folder: str, write: Callable[[str], Callable]) -> DataFrame:
    """Runs the job; (name, bytes, members) of each file."""
    target = qualified(rows.sparkSession, folder).rstrip("/")
    system, base = fs.FileSystem.from_uri(target)
    if system.get_file_info(base).type != fs.FileType.NotFound:
        raise FileExistsError(folder)
    draft = f"{target}._draft-{uuid.uuid4().hex}"
    place = fs.FileSystem.from_uri(draft)[1]
    system.create_dir(f"{place}/_attempts", recursive=True)
    try:
        done = cut(rows.mapInArrow(write(draft), WRITTEN))
        system.delete_dir(f"{place}/_attempts")
        system.move(place, base)
        return done
    except BaseException:
        system.delete_dir(place)
        raise


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "png") -> DataFrame:
    """A file for each row, under `folder`; names are different. (name, bytes, members) of each."""

    def write(draft):
        def run(stream: Iterator[pa.RecordBatch]):
            at = _Draft(draft)
            for rb in stream:
                out = []
                for n, data in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                    with at.open() as f:
                        f.write(data.as_buffer())
                    out.append((n, at.finish(n), 1))
                if out:
                    yield _rows(out)

        return run

    return _committed(rows.where(F.col(content).isNotNull()).select(name, content), folder, write)


def write_archives(files: DataFrame, folder: str, metadata: DataFrame | None = None) -> DataFrame:
    """One ZIP per video of files (video_id, source_video, seq, name, content), under `folder`: (name, bytes, members) of each.

    metadata: (video_id, metadata), whose text each archive holds as metadata.json after the images. A video's files
    stand in order in one task, which writes members as they come: it holds one of them and the archive's directory.
    Archives of one name (of different videos) bear the video's id too.
    """
    member = files.select("video_id", "source_video", F.lit(0).alias("kind"), F.col("seq").cast("long").alias("seq"), "name", "content")
    if metadata is not None:
        videos = files.groupBy("video_id").agg(F.min("source_video").alias("source_video"))
        last = metadata.where("metadata is not null").join(videos, "video_id").select("video_id", "source_video", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit("metadata.json").alias("name"), F.col("metadata").cast("binary").alias("content"))
        member = member.unionByName(last)
    names = files.select("video_id", "source_video").groupBy("video_id").agg(F.min("source_video").alias("source_video"))
    twice = cut(names.groupBy("source_video").count().where("count > 1").select("source_video", F.lit(True).alias("twice")))
    member = member.join(twice, "source_video", "left").select("video_id", "kind", "seq", "name", "content", "source_video", F.coalesce("twice", F.lit(False)).alias("twice"))
    member = member.repartition("video_id").sortWithinPartitions("video_id", "kind", "seq", "name")

    def write(draft):
        def run(stream: Iterator[pa.RecordBatch]):
            at, now, z, f, n, title = _Draft(draft), None, None, None, 0, ""

            def close():
                z.close()
                f.close()
                return _rows([(title, at.finish(title), n)])

            for rb in stream:
                for k in range(rb.num_rows):
                    video, _, _, name, content, source, both = (c[k] for c in rb.columns)
                    if z is None or video.as_py() != now:
                        if z is not None:
                            yield close()
                        now, n = video.as_py(), 0
                        title = source.as_py().rsplit(".", 1)[0] + (f"_{now}" if both.as_py() else "") + K.ARCHIVE_SUFFIX
                        f = at.open()
                        z = zipfile.ZipFile(f, "w", zipfile.ZIP_STORED)
                    with z.open(zipfile.ZipInfo(name.as_py()), "w", force_zip64=False) as out:
                        out.write(content.as_buffer() if content.is_valid else b"")
                    n += 1
            if z is not None:
                yield close()

        return run

    return _committed(member, folder, write)
