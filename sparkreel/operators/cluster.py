"""What operators share about running on a cluster: the shared folder, lineage, and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (some tens of bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where none is set, as in tests, one is made in the warehouse."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme: one without is resolved as Spark does it, by fs.defaultFS."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage: the rows are written to the shared folder and read back from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(narrow: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table for a join: computed once, and broadcast if it has at most `rows` rows."""
    narrow = cut(narrow)
    return F.broadcast(narrow) if narrow.count() <= rows else narrow
