"""Sampling, classification and segmentation of ordered frames.

All orders are explicit: (video_id, idx). One shuffle on video_id serves every window here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X


def resample(frames: DataFrame, slot: F.Column, end_slot: F.Column) -> DataFrame:
    """Fixed-rate slots: slot k holds the last frame whose rounded slot is at most k.

    frames: (video_id, n, ...); slot and end_slot: rounded slots of a frame's start and end.
    A gap repeats a frame, a frame that a later one overtakes in its slot is dropped. This is
    an interval expansion over lead(), not a join.
    """
    order = W.partitionBy("video_id").orderBy("n")
    f = frames.withColumns({"_r": slot, "_e": end_slot})
    f = f.withColumn("_r", F.max("_r").over(order.rowsBetween(W.unboundedPreceding, 0)))
    f = f.withColumn("_to", F.coalesce(F.lead("_r").over(order), F.col("_e")))
    return f.where("_to > _r").withColumn("slot", F.explode(F.sequence("_r", F.col("_to") - 1))).drop("_r", "_e", "_to")


def monotone(rows: DataFrame, number: str, order: str) -> DataFrame:
    """Rows whose number is above every number before: repeated deliveries go."""
    before = W.partitionBy("video_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_m", F.max(number).over(before)).where(F.col("_m").isNull() | (F.col(number) > F.col("_m"))).drop("_m")


def classify(metrics: DataFrame) -> DataFrame:
    """(video_id, idx, bm, dk, hd) with t, cat and boundary."""
    return metrics.withColumn("t", X.seconds(F.col("idx"))).withColumn("cat", X.categorize(F.col("bm"), F.col("dk"))).withColumn("boundary", X.is_boundary(F.col("cat"), F.col("hd")))


def rises(frames: DataFrame) -> DataFrame:
    """Frames with rise: a boundary frame after one that is none."""
    order = W.partitionBy("video_id").orderBy("idx")
    return frames.withColumn("rise", F.col("boundary") & ~F.lag("boundary", 1, False).over(order))


def segments(frames: DataFrame) -> DataFrame:
    """Frames without loading ones, with their segment from 0. Segments without frames do not count."""
    order = W.partitionBy("video_id").orderBy("idx")
    f = rises(frames).withColumn("_g", F.sum(F.col("rise").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    f = f.where("cat <> 'loading'")
    return f.withColumn("seg", F.dense_rank().over(W.partitionBy("video_id").orderBy("_g")) - 1).drop("_g", "rise")


def summarize(segmented: DataFrame) -> DataFrame:
    """One row per segment: its extent and the frames of each category."""
    counts = [F.count_if(F.col("cat") == c).alias(f"n_{c}") for c in K.CATEGORIES]
    return segmented.groupBy("video_id", "seg").agg(F.min("idx").alias("idx_start"), F.max("idx").alias("idx_end"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), *counts)


def totals(frames: DataFrame, summary: DataFrame) -> DataFrame:
    """Per video: rises (of all frames, since empty segments vanish), segments, segments with a detail frame."""
    r = rises(frames).groupBy("video_id").agg(F.count_if("rise").alias("boundary_rises"))
    s = summary.groupBy("video_id").agg(F.count("*").alias("segments"), F.count_if(F.col("n_detail") > 0).alias("mail_segments"))
    return r.join(s, "video_id", "left").fillna(0, ["segments", "mail_segments"])


def counted(stable: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
    """The frames, and counters that are filled in passing when they are first read: no pass of their own.

    frames, details, stable, last_frame over all rows; `observation.get` waits for the first action.
    """
    seen = Observation(name) if name else Observation()
    counters = [F.count(F.lit(1)).alias("frames"), F.count_if(F.col("cat") == "detail").alias("details"), F.count_if("stable").alias("stable"), F.max("idx").cast("long").alias("last_frame")]
    return stable.observe(seen, *counters), seen
