"""Text recognition attempts: which frames are tried, and what comes of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from .cluster import small_side


def spaced(frames: DataFrame, spacing: int = K.OCR_SPACING) -> DataFrame:
    """Detail frames of each segment that are `spacing` or more after the last one taken.

    "Last taken" is a running state, so this is a fold over a segment's indexes.
    """
    idx = frames.groupBy("video_id", "seg").agg(F.array_sort(F.collect_list("idx")).alias("_i"))
    none = F.filter("_i", lambda x: F.lit(False))
    taken = F.aggregate("_i", none, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= spacing), F.array_append(acc, x)).otherwise(acc))
    return idx.select("video_id", "seg", F.explode(taken).alias("idx"))


def attempts(taken: DataFrame, limit: int = K.OCR_ATTEMPTS) -> DataFrame:
    """The first `limit` candidates of each segment, numbered from 1."""
    n = F.row_number().over(W.partitionBy("video_id", "seg").orderBy("idx"))
    return taken.withColumn("attempt", n).where(F.col("attempt") <= limit)


def outcomes(tried: DataFrame) -> DataFrame:
    """Attempts that really run: segments in order, each until its first time stamp.

    tried: (video_id, seg, idx, attempt, timestamp, error). An error counts as a failed attempt;
    OCR_ERRORS of them in a row, over segments, stop the video (that last one gives no result).
    """
    before = W.partitionBy("video_id", "seg").orderBy("attempt").rowsBetween(W.unboundedPreceding, -1)
    runs = tried.withColumn("_found", F.max(F.col("timestamp").isNotNull() & ~F.col("error")).over(before)).where("_found is null or not _found").drop("_found")
    order = W.partitionBy("video_id").orderBy("seg", "attempt")
    runs = runs.withColumn("_g", F.sum((~F.col("error")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    streak = F.row_number().over(W.partitionBy("video_id", "_g").orderBy("seg", "attempt"))
    runs = runs.withColumn("_streak", F.when(F.col("error"), streak - F.when(F.col("_g") > 0, 1).otherwise(0)).otherwise(0))
    stopped = F.coalesce(F.max(F.col("_streak") >= K.OCR_ERRORS).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(False))
    return runs.withColumn("_stopped", stopped).where("not _stopped").drop("_g", "_streak", "_stopped")


def results(runs: DataFrame) -> DataFrame:
    """Per segment: attempts, whether a time stamp was found, and the first one."""
    ok = ~F.col("error") & F.col("timestamp").isNotNull()
    return runs.groupBy("video_id", "seg").agg(F.count("*").alias("attempts"), F.max(ok).alias("found"), F.min_by("timestamp", F.when(ok, F.col("attempt"))).alias("timestamp"))


CROPS = "video_id long, seg int, idx int, attempt int, timestamp_png binary, sender_png binary"


def crops(frames: DataFrame, tried: DataFrame) -> DataFrame:
    """The enlarged gray crops of the attempts (video_id, seg, idx, attempt), from pixel frames.

    The attempts are chosen first, on narrow rows, and joined to the pixels, so no frame is cropped
    that nobody tries.
    """

    def run(stream):
        import pandas as pd

        from ..functions import pixels as P
        from ..sources.images import png, rgb

        for pdf in stream:
            rows = []
            for r in pdf.itertuples(index=False):
                img = rgb(r.data, r.height, r.width, r.n_channels)
                rows.append((r.video_id, r.seg, r.idx, r.attempt, *(png(P.crop_upscaled(img, part)) for part in (K.OCR_TIMESTAMP, K.OCR_SENDER))))
            yield pd.DataFrame(rows, columns=["video_id", "seg", "idx", "attempt", "timestamp_png", "sender_png"])

    return frames.join(small_side(tried.select("video_id", "seg", "idx", "attempt")), ["video_id", "idx"]).mapInPandas(run, CROPS)


def recognised(crops: DataFrame, recognise, schema: str = "video_id long, seg int, idx int, timestamp string, sender string, error boolean") -> DataFrame:
    """Applies a recogniser (a function of batches of crops) in tasks. It is the caller's: none is built in."""
    return crops.mapInPandas(recognise, schema)


@dataclass
class Segment:
    """What is known of a segment in the streaming variant."""

    tries: int = 0
    last: int | None = None
    found: bool = False
    dropped: int = 0


@dataclass
class Waiting:
    """Frames of one video that wait for recognition: rows (seg, idx, crop) in order of arrival.

    A segment takes a frame while it has no time stamp, its tries and waiting frames are fewer
    than `attempts`, fewer than `waiting` wait, and the frame is `spacing` or more after the one it
    took last. All segments together hold `total` frames, and each has a fair share of them:
    total // (segments with waiting frames, the newcomer's included), 1 at least. When all places
    are taken, a segment below its share still gets one: the segment with most frames, if it is
    above the share, loses the frame that tells least, which is the one with the smallest time
    between its neighbours (so the first and the last of a segment stay, as long as there are
    others). If nobody is above the share, the segment that has waited longest loses one. Below
    22 segments every segment so keeps 3 of 64 places, up to 64 segments one.

    Frames refused after their spacing, and frames given up, count as dropped. `errors` failures
    of the recogniser in a row stop the video: nothing waits any more, and nothing is taken.
    """

    attempts: int = K.OCR_ATTEMPTS
    total: int = K.OCR_TOTAL
    waiting: int = K.OCR_WAITING
    spacing: int = K.OCR_SPACING
    errors: int = K.OCR_ERRORS
    rows: list[tuple] = field(default_factory=list)
    segments: dict[int, Segment] = field(default_factory=dict)
    failures: int = 0
    stopped: bool = False

    def held(self) -> dict[int, list[int]]:
        """Places in `rows` by segment, segments in order of arrival."""
        by: dict[int, list[int]] = {}
        for place, row in enumerate(self.rows):
            by.setdefault(row[0], []).append(place)
        return by

    def _loser(self, seg: int) -> int | None:
        """The place that a frame of `seg` would take when all are taken."""
        by = self.held()
        share = max(1, self.total // len(by.keys() | {seg}))
        if len(by.get(seg, ())) >= share:
            return None
        rest = {k: v for k, v in by.items() if k != seg}
        full = max(rest.values(), key=len, default=[])
        if len(full) <= share:
            return next(iter(rest.values()))[0] if rest else None
        inner = range(1, len(full) - 1)
        return full[min(inner, key=lambda k: self.rows[full[k + 1]][1] - self.rows[full[k - 1]][1])] if inner else full[-1]

    def admits(self, seg: int, idx: int) -> bool:
        """Whether `offer` would take this frame; asked before anything is cropped."""
        s = self.segments.get(seg, Segment())
        n = sum(r[0] == seg for r in self.rows)
        spaced_ = s.last is None or idx - s.last >= self.spacing
        open_ = not (self.stopped or s.found) and s.tries + n < self.attempts and n < self.waiting
        return open_ and spaced_ and (len(self.rows) < self.total or self._loser(seg) is not None)

    def offer(self, seg: int, idx: int, crop=None) -> bool:
        """Takes a frame, or counts it as dropped. crop: its image, or a function that makes it."""
        s = self.segments.get(seg)
        if not self.admits(seg, idx):
            if s and not (s.found or self.stopped) and idx - s.last >= self.spacing:
                s.dropped += 1
            return False
        if len(self.rows) >= self.total:
            lost = self.rows.pop(self._loser(seg))
            self.segments[lost[0]].dropped += 1
        s = self.segments.setdefault(seg, Segment())
        s.last = idx
        self.rows.append((seg, idx, crop() if callable(crop) else crop))
        return True

    def take(self) -> tuple | None:
        """The next frame to recognise, (seg, idx, crop, attempt): the first of the lowest segment."""
        if not self.rows:
            return None
        place = min(range(len(self.rows)), key=lambda k: (self.rows[k][0], k))
        seg, idx, crop = self.rows.pop(place)
        self.segments[seg].tries += 1
        return seg, idx, crop, self.segments[seg].tries

    def told(self, seg: int, found: bool, error: bool = False) -> None:
        """What the recogniser made of the frame taken last: a time stamp ends the segment."""
        self.failures = self.failures + 1 if error else 0
        if found and not error:
            self.segments[seg].found = True
            self.rows = [r for r in self.rows if r[0] != seg]
        if self.failures >= self.errors:
            self.stopped, self.rows = True, []
