"""Final file names of exported images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X


def with_metadata(outputs: DataFrame, seg_meta: DataFrame) -> DataFrame:
    """Outputs with what is known of their segment, null where nothing is."""
    return outputs.join(seg_meta, ["video_id", "seg"], "left")


def assign_names(outputs: DataFrame) -> DataFrame:
    """Included outputs with their name.

    outputs: (video_id, seq, kind, seg, included, edited_ts, timestamp, part_index, part_total).
    Images count on their own. A mail's head takes a number and a name: an output that is no part,
    a part 1, or the first included part of its segment; further parts share the name of the head
    before them. A time stamp that comes again gets _2, _3 and so on; without one, the number of
    the mail is the name.
    """
    order = W.partitionBy("video_id").orderBy("seq")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    o = outputs.where("included").withColumn("_ts", F.coalesce(F.col("edited_ts"), F.col("timestamp")))
    o = o.withColumn("_ts", F.nullif("_ts", F.lit("")))
    seg = W.partitionBy("video_id", "kind", "seg", F.col("part_index").isNull()).orderBy("seq")
    head = (F.col("kind") == "mail") & (F.col("part_index").isNull() | (F.col("part_index") <= 1) | (F.row_number().over(seg) == 1))
    o = o.withColumn("_head", head)
    o = o.withColumns({"_mail": F.sum(F.col("_head").cast("int")).over(upto), "_image": F.sum((F.col("kind") == "image").cast("int")).over(upto)})
    again = F.row_number().over(W.partitionBy("video_id", "_ts", "_head").orderBy("seq")) - 1
    base = F.when(F.col("_head"), X.mail_file(F.col("_ts"), F.col("_mail"), F.when(F.col("_ts").isNotNull(), again).otherwise(0)))
    o = o.withColumn("_base", base)
    shared = F.last("_base", ignorenulls=True).over(seg.rowsBetween(W.unboundedPreceding, 0))
    part = F.concat(X.stem(shared), F.format_string(K.PART_SUFFIX + ".png", "part_index", "part_total"))
    name = F.when(F.col("kind") == "image", X.image_file(F.col("_image"))).when(F.col("part_index").isNotNull(), part).otherwise(F.col("_base"))
    return o.withColumn("name", name).drop("_ts", "_head", "_mail", "_image", "_base")


def provisional_name(kind: F.Column, ordinal: F.Column, seg: F.Column, t: F.Column, stitched: F.Column | None = None, part_index: F.Column | None = None, part_total: F.Column | None = None) -> F.Column:
    """Name of an output while its video is still being read.

    A stitched mail in several parts names the part, one in a single part says that it is stitched.
    """
    mail = F.format_string(K.PROVISIONAL_MAIL, ordinal, seg, F.format_string("%.3f", t))
    if stitched is not None:
        total = F.lit(1) if part_total is None else F.coalesce(part_total, F.lit(1))
        part = F.lit("") if part_total is None else F.format_string(K.PART_SUFFIX, part_index, part_total)
        mail = F.concat(mail, F.when(stitched & (total > 1), part).when(stitched, K.STITCHED_SUFFIX).otherwise(""))
    return F.when(kind == "image", X.image_file(ordinal)).otherwise(F.concat(mail, F.lit(".png")))


def metadata(named: DataFrame) -> DataFrame:
    """One JSON array per video with an object for each included output, in order."""
    item = F.struct(
        "seq",
        F.struct(
            F.col("name").alias("file"), "kind", F.col("_ts").alias("timestamp"), "sender", "source_video",
            F.array("idx_start", "idx_end").alias("frame_range"), F.array("t_start", "t_end").alias("time_range_sec"),
            F.col("idx").alias("representative_frame"), "stitched",
        ).alias("m"),
    )
    rows = named.withColumn("_ts", F.nullif(F.coalesce("edited_ts", "timestamp"), F.lit("")))
    return rows.groupBy("video_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]), {"ignoreNullFields": "false"}).alias("metadata"))
