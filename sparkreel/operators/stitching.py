"""Scroll stitching: from correlated frame pairs to canvas rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X


def decide(pairs: DataFrame, height: F.Column, skip: F.Column) -> DataFrame:
    """The decision for each frame i of a segment and the rows it adds.

    pairs: (video_id, seg, i, dx, dy, response, identical); i = 0 is the first frame, which is
    placed whole. dy is positive for a scroll down. A pair that is rejected still moves the
    comparison on, so every row stands for frames i - 1 and i.
    """
    reason = (
        F.when(F.col("i") == 0, "first")
        .when(F.coalesce("identical", F.lit(False)), "static")
        .when((F.col("response") < K.MIN_RESPONSE) | (F.abs("dx") > K.MAX_DX), "weak_or_shift")
        .when(F.col("dy") < K.MIN_DY, "static")
        .otherwise("accepted")
    )
    rows = F.when(F.col("_why") == "first", height).when(F.col("_why") == "accepted", X.added_rows(F.col("dy"), height, skip)).otherwise(0)
    out = pairs.withColumn("_why", reason).withColumn("add_rows", rows.cast("int")).withColumn("accepted", F.col("_why").isin("first", "accepted"))
    return out.withColumn("reason", F.when(F.col("_why") != "accepted", F.col("_why"))).drop("_why")


def needs_recheck(response: F.Column, scale: int = K.CORR_SCALE) -> F.Column:
    """Whether a scaled correlation is too unsure and is repeated at full size."""
    return F.lit(scale != 1) & (response >= K.RECHECK_LOW) & (response < K.RECHECK_HIGH)


def place(decisions: DataFrame) -> DataFrame:
    """Where each frame's rows begin and how high the canvas is then."""
    upto = W.partitionBy("video_id", "seg").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    d = decisions.withColumn("canvas", F.sum(F.col("add_rows").cast("long")).over(upto))
    return d.withColumn("dst_row", F.col("canvas") - F.col("add_rows"))


def fixed_rows(estimates: DataFrame, initial: F.Column) -> DataFrame:
    """The fixed header height in force at each accepted pair: the first estimate replaces the
    carried value, later ones only lower it. estimates: (video_id, i, est), est null without one."""
    upto = W.partitionBy("video_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return estimates.withColumn("skip", F.coalesce(F.min("est").over(upto), initial))


def estimate_fixed_rows(row_diff: F.Column, height: F.Column) -> F.Column:
    """Leading rows whose mean difference is below the limit, at most a quarter of the height."""
    cap = (height.cast("double") * K.FIXED_ROW_MAX).cast("int")
    first = F.array_position(F.transform(F.slice(row_diff, 1, cap), lambda d: (d >= K.FIXED_ROW_DIFF).cast("int")), 1)
    return F.when(first > 0, first - 1).otherwise(F.least(cap, F.size(row_diff))).cast("int")


def row_diff(a: F.Column, b: F.Column, width: F.Column) -> F.Column:
    """Mean absolute difference of each pixel row of two row-major images."""
    diff = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    rows = F.sequence(F.lit(0), (F.size(a) / width).cast("int") - 1)
    return F.transform(rows, lambda y: F.aggregate(F.slice(diff, y * width + 1, width), F.lit(0).cast("long"), lambda s, v: s + v) / width)


def capped(decisions: DataFrame, max_rows: F.Column) -> DataFrame:
    """Canvas height per segment under a row limit. An addition that does not fit is dropped
    whole and counted; a later, smaller one may fit. The first frame is cut instead."""
    item = F.struct("i", F.col("add_rows").cast("long").alias("add_rows"))
    rows = decisions.groupBy("video_id", "seg").agg(F.max(max_rows.cast("long")).alias("cap"), F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("truncated"))

    def step(acc, x):
        fits = acc["rows"] + x["add_rows"] <= F.col("cap")
        first = F.least(x["add_rows"], F.col("cap"))
        placed = F.when(x["i"] == 0, first).when(fits, x["add_rows"]).otherwise(F.lit(0).cast("long"))
        return F.struct((acc["rows"] + placed).alias("rows"), (acc["truncated"] + x["add_rows"] - placed).alias("truncated"))

    return rows.withColumn("c", F.aggregate("items", zero, step)).select("video_id", "seg", F.col("c.rows").alias("height"), F.col("c.truncated").alias("truncated_rows"))


def parts(canvases: DataFrame, height: str = "height", limit: int = K.PART_ROWS) -> DataFrame:
    """The pieces of at most `limit` rows in which a canvas is exported: index from 1, total, first row, rows."""
    n = F.ceil(F.col(height) / limit).cast("int")
    out = canvases.where(F.col(height) > 0).withColumn("part_total", n).withColumn("part_index", F.explode(F.sequence(F.lit(1), n)))
    start = (F.col("part_index") - 1) * limit
    return out.withColumn("part_row", start.cast("long")).withColumn("part_rows", F.least(F.lit(limit), F.col(height) - start).cast("long"))


def closed(decisions: DataFrame) -> DataFrame:
    """Per segment: accepted scrolls (the first frame is none) and the stitched height, null without any."""
    n = F.count_if(F.col("accepted") & (F.col("i") > 0))
    return decisions.groupBy("video_id", "seg").agg(n.alias("accepted"), F.sum(F.col("add_rows").cast("long")).alias("_h")).withColumn("height", F.when(F.col("accepted") > 0, F.col("_h"))).drop("_h")


def ms_per_frame(ms: F.Column) -> F.Column:
    """Mean time of the frames, 0 without any."""
    return F.coalesce(F.sum(ms) / F.nullif(F.count(ms), F.lit(0)), F.lit(0.0))
