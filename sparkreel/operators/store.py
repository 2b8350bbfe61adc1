"""The job and output store as transformations of append-only logs and tables.

A table is a Parquet folder; a change is a DataFrame in, a DataFrame out, so a writer can
merge it with foreachBatch or rewrite the partition of a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K


def latest(log: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The last row of each key: an upsert log read as a table."""
    newest = W.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def listed(jobs: DataFrame) -> DataFrame:
    """Jobs, last changed first."""
    return jobs.orderBy(F.desc("updated_at"), F.desc("created_at"), "id")


def outputs_of(outputs: DataFrame, job_id) -> DataFrame:
    """Outputs of one job in order. With the table partitioned by job, this reads one partition."""
    return outputs.where(F.col("job_id") == F.lit(job_id)).orderBy("seq")


def patch(jobs: DataFrame, patches: DataFrame, key: str, columns: list[str], now: F.Column | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """jobs with the columns that a patch names; a patch of null is told apart by has_<column>.

    A patch for a job that is not there changes the job's row in `fallback` (columns of jobs) and
    adds it; without such a row it does nothing.
    """
    p = patches.select(key, *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"has_{c}").alias(f"_has_{c}") for c in columns], F.lit(True).alias("_hit"))
    if fallback is not None:
        absent = fallback.join(p.select(key), key, "left_semi").join(jobs.select(key), key, "left_anti")
        jobs = jobs.unionByName(absent.select(*jobs.columns))
    j = jobs.join(p, key, "left")
    for c in columns:
        j = j.withColumn(c, F.when(F.col(f"_has_{c}"), F.col(f"_{c}")).otherwise(F.col(c)))
    if now is not None:
        j = j.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
    return j.select(*jobs.columns)


def folded(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Per key the last non-null value of each column: field-level merges of an event log."""
    upto = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cols = [F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns]
    return events.select(key, *cols).distinct()


def heartbeat(jobs: DataFrame, job_id: F.Column, owner: F.Column, now: F.Column) -> DataFrame:
    """A running job's sign of life, from its owner only."""
    hit = (F.col("id") == job_id) & (F.col("owner_id") == owner) & (F.col("status") == "running")
    return jobs.withColumn("heartbeat_at", F.when(hit, now).otherwise(F.col("heartbeat_at")))


def interrupted(jobs: DataFrame, self_id: F.Column, now: F.Column) -> DataFrame:
    """Running jobs of others without a sign of life for more than STALE_MS become interrupted."""
    silent = F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") == 0) | (now - F.col("heartbeat_at") > K.STALE_MS)
    gone = (F.col("status") == "running") & ~F.col("owner_id").eqNullSafe(self_id) & silent
    return jobs.withColumn("marked", gone).withColumn("status", F.when(F.col("marked"), "interrupted").otherwise(F.col("status")))


def edit_outputs(outputs: DataFrame, edits: DataFrame) -> DataFrame:
    """Changes of `included` and `edited_ts` by key; unknown keys change nothing."""
    e = edits.select("key", F.col("included").alias("_i"), F.col("edited_ts").alias("_t"))
    j = outputs.join(e, "key", "left")
    return j.withColumns({"included": F.coalesce("_i", "included"), "edited_ts": F.coalesce("_t", "edited_ts")}).select(*outputs.columns)


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose job was not deleted; the same call serves jobs and their outputs."""
    return table.join(gone.select(F.col(key)).distinct(), key, "left_anti")


def cleared(table: DataFrame) -> DataFrame:
    """A table of the same columns without rows: what both tables become when the store is cleared."""
    return table.where(F.lit(False))


def merged_meta(updates: DataFrame) -> DataFrame:
    """Per video a map from segment to its metadata; later fields replace earlier ones, absent ones stay."""
    one = folded(updates.withColumn("_k", F.struct("video_id", "seg")), "_k", ["n"], ["timestamp", "sender"])
    item = F.struct(F.col("_k.seg").alias("seg"), F.struct("timestamp", "sender").alias("meta"))
    return one.groupBy(F.col("_k.video_id").alias("video_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(item))).alias("seg_meta"))
