"""From frames of recordings to exported images: the whole batch plan.

measured (one Arrow pass over pixels, written once) -> categories -> segments by windows ->
representatives and repeats -> stitched scrolls -> outputs. After the first pass everything is
narrow; the narrow tables are then joined to the pixels of the frames that are exported or
stitched, by broadcast after a count, so pixels are shuffled only to bring a segment's scrolled
frames together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import pixels as P
from ..functions import stitch as S
from ..operators import frames as fr
from ..operators import select
from ..operators.cluster import cut, small_side
from ..sources.images import TallPng, cropped_png, rgb


def measured(frames: DataFrame) -> DataFrame:
    """(video_id, idx, bm, dk, hd, h) of frames, in one pass; blank (loading) frames get no hash."""

    def run(stream):
        for pdf in stream:
            rows = []
            for r in pdf.itertuples(index=False):
                img = rgb(r.data, r.height, r.width, r.n_channels)
                bm, dk, hd = P.metrics(img)
                blank = bm < K.LOADING_BM and dk <= K.FULLSCREEN_DK
                rows.append((r.video_id, r.idx, bm, dk, hd, None if blank else P.phash(P.gray_pillow(img))))
            out = pd.DataFrame(rows, columns=["video_id", "idx", "bm", "dk", "hd", "h"])
            yield out.astype({"h": "Int64"})

    return frames.mapInPandas(run, "video_id long, idx int, bm double, dk double, hd double, h long")


STITCHED = "video_id long, seg int, accepted long, height long, truncated long, png binary"


class _Shifts:
    """Decisions of a segment that is read in order: one gray frame and its spectra are held."""

    def __init__(self, key: tuple, header: S.Header, scale: int):
        self.key, self.header, self.scale = key, header, scale
        self.spectra, self.before, self.n = S.Spectra(), None, 0

    def add(self, r) -> tuple[np.ndarray, dict]:
        img = rgb(r.data, r.height, r.width, r.n_channels)[int(r.height * K.STATUS_BAR) :]
        gray = P.gray_cv(img)
        d = S.step(self.spectra, self.n, self.before, gray, self.header, self.scale, self.scale > 1)
        self.before, self.n = gray, self.n + 1
        return img, d


class _Tall(_Shifts):
    """A segment that is being stitched, with the rows placed so far as compressed PNG."""

    def __init__(self, r, header: S.Header, scale: int):
        super().__init__((r.video_id, r.seg), header, scale)
        self.canvas = S.Canvas(max(1, K.MAX_STITCH_BYTES // (r.width * 4)))
        self.accepted, self.image = 0, TallPng(r.width)

    def add(self, r) -> None:
        img, d = super().add(r)
        if d["accepted"]:
            self.image.add(S.strip(img, d, self.canvas.place(d["add_rows"])))
            self.accepted += d["reason"] is None

    def row(self) -> tuple:
        some = self.accepted > 0
        return (*self.key, self.accepted, self.canvas.rows if some else None, self.canvas.truncated, self.image.finish() if some else None)


HEADERS = "video_id long, seg int, h_rows int, h_known boolean, least int"


def headers(rows: DataFrame, scale: int = 1) -> DataFrame:
    """(video_id, seg, h_rows, h_known): the header estimate with which each segment begins, as one pass over its video in order would carry it.

    A segment begins with the lowest estimate of all segments before it, and what it estimates itself
    depends on that. So all segments are first judged as if nothing were known, each by itself, then the
    prefix minimum of their estimates says how each begins, and those that began otherwise are
    judged again, until none does. The first wrong segment of a video is right after each round, so
    this ends, and it ends with what the serial pass gives; one or two rounds are usual, as
    estimates settle with the first scrolls.
    """
    begins = rows.select("video_id", "seg").distinct().withColumns({"h_rows": F.lit(0), "h_known": F.lit(False)})
    told = None
    before = W.partitionBy("video_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)

    def run(stream):
        now, made, names = None, None, [c.split()[0] for c in HEADERS.split(", ")]
        frame = lambda t, r: pd.DataFrame([(*t.key, *r, t.header.least)], columns=names).astype({"least": "Int64"})
        for pdf in stream:
            for r in pdf.itertuples(index=False):
                if now is None or now.key != (r.video_id, r.seg):
                    if now is not None:
                        yield frame(now, made)
                    made = (r.h_rows, r.h_known)
                    now = _Shifts((r.video_id, r.seg), S.Header(int(r.h_rows), True, bool(r.h_known)), scale)
                now.add(r)
        if now is not None:
            yield frame(now, made)

    while True:
        some = rows.join(small_side(begins), ["video_id", "seg"]).repartition("video_id", "seg").sortWithinPartitions("video_id", "seg", "idx")
        new = cut(some.select("video_id", "seg", "idx", "width", "height", "n_channels", "data", "h_rows", "h_known").mapInPandas(run, HEADERS))
        told = new if told is None else cut(told.join(new.select("video_id", "seg"), ["video_id", "seg"], "left_anti").unionByName(new))
        lowest = F.min("least").over(before)
        due = told.withColumns({"_rows": F.coalesce(lowest, F.lit(0)), "_known": lowest.isNotNull()})
        begins = cut(due.where("_rows <> h_rows or _known <> h_known").select("video_id", "seg", F.col("_rows").alias("h_rows"), F.col("_known").alias("h_known")))
        if begins.isEmpty():
            return told.select("video_id", "seg", "h_rows", "h_known")


def stitched(frames: DataFrame, segmented: DataFrame, auto: bool = False, scale: int = 1) -> DataFrame:
    """Per segment: (video_id, seg, accepted, height, truncated, png) of its stitched detail frames.

    A task reads its segments' frames in order and holds one frame and the compressed image so far,
    however long a segment is. With auto header estimation headers() says first with which estimate a
    segment begins, so the segments of a video are spread over the tasks then, too.
    """
    detail = segmented.where("cat = 'detail'").select("video_id", "idx", "seg")
    rows = frames.join(small_side(detail), ["video_id", "idx"])
    if auto:
        rows = rows.join(small_side(headers(rows, scale)), ["video_id", "seg"])
    else:
        rows = rows.withColumns({"h_rows": F.lit(0), "h_known": F.lit(False)})
    rows = rows.repartition("video_id", "seg").sortWithinPartitions("video_id", "seg", "idx")

    def run(stream):
        now, names = None, [c.split()[0] for c in STITCHED.split(", ")]
        frame = lambda t: pd.DataFrame([t.row()], columns=names).astype({"height": "Int64"})
        for pdf in stream:
            for r in pdf.itertuples(index=False):
                if now is None or now.key != (r.video_id, r.seg):
                    if now is not None:
                        yield frame(now)
                    now = _Tall(r, S.Header(int(r.h_rows), auto, bool(r.h_known)), scale)
                now.add(r)
        if now is not None:
            yield frame(now)

    return rows.select("video_id", "seg", "idx", "width", "height", "n_channels", "data", "h_rows", "h_known").mapInPandas(run, STITCHED)


def exported(frames: DataFrame, stitch: bool = True, auto: bool = False) -> DataFrame:
    """Selected outputs of recordings: (video_id, seg, kind, idx, t, event, reason, stitched, png).

    A mail's image is its stitched scroll if there was any scroll, else its representative frame
    without the status bar. Skipped outputs stay, with the reason and without an image.
    """
    seg = cut(fr.segments(fr.classify(cut(measured(frames)))))
    events = cut(select.select_events(select.stability(seg)))
    chosen = events.where("event = 'selected'").select("video_id", "seg", "kind", "idx")

    def encode(stream):
        for pdf in stream:
            pdf["png"] = [cropped_png(np.ascontiguousarray(rgb(r.data, r.height, r.width, r.n_channels)), K.STATUS_BAR) for r in pdf.itertuples(index=False)]
            yield pdf[["video_id", "idx", "kind", "png"]]

    singles = frames.join(small_side(chosen), ["video_id", "idx"]).mapInPandas(encode, "video_id long, idx int, kind string, png binary")
    out = events.join(singles.withColumnRenamed("png", "_one"), ["video_id", "idx", "kind"], "left")
    if stitch:
        s = stitched(frames, seg, auto).where("accepted > 0").select("video_id", "seg", F.lit("mail").alias("kind"), F.col("png").alias("_tall"))
        out = out.join(s, ["video_id", "seg", "kind"], "left")
    else:
        out = out.withColumn("_tall", F.lit(None).cast("binary"))
    keep = F.col("event") == "selected"
    return out.select("video_id", "seg", "kind", "idx", (F.col("idx") / F.lit(float(K.FPS))).alias("t"), "event", "reason", (keep & F.col("_tall").isNotNull()).alias("stitched"), F.when(keep, F.coalesce("_tall", "_one")).alias("png"))
