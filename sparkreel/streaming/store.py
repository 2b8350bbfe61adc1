"""The job and output store fed by streams: a versioned table whose merges are idempotent by batch.

A table is a folder with data files in buckets of its key and a manifest for each version, which names
each bucket's folder and the last batch of every query that the version holds. A merge rewrites only the buckets
that a batch touches and then creates the next manifest, which exists or doesn't: a batch
that a restarted query hands over again is in the manifest already and changes nothing, and
what a failed merge wrote is in none. Two writers of one version can't both create it; the
second one merges again. Readers hold on to the version that they began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store
from ..operators.cluster import cut

BUCKETS, TRIES = 16, 5

#: (rows of the touched buckets, the batch) -> the buckets' new rows.
Change = Callable[[DataFrame, DataFrame], DataFrame]


class Table:
    """Rows of `schema` with a key, in `buckets` buckets (fixed when the table is made)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The newest version; 0 is the empty table."""
        fs, p = self._file("manifest")
        return max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p)), default=0) if fs.exists(p) else 0

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": {}, "batches": {}}
        fs, p = self._file(f"manifest/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, version: int, manifest: dict) -> bool:
        """Whether this version is ours: it is written beside its place and moved there, which fails if it exists."""
        fs, draft = self._file(f"drafts/{uuid.uuid4().hex}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, place = self._file(f"manifest/{version:012d}.json")
        fs.mkdirs(place.getParent())
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            return False
        return True

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        return self._rows(self.manifest(version), buckets)

    def _rows(self, manifest: dict, buckets: list[int] | None) -> DataFrame:
        at = [f"{self.path}/{p}" for b, p in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, change: Change, query: str, batch_id: int) -> bool:
        """Applies a batch; False if the table holds it already. Rows whose key is null are nobody's and go."""
        batch = batch.where(F.col(self.key).isNotNull())
        if self.manifest()["batches"].get(query, -1) >= batch_id:
            return False
        batch = cut(batch)
        touched = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())  # at most `buckets` numbers
        for _ in range(TRIES):
            old = self.manifest()
            if old["batches"].get(query, -1) >= batch_id:
                return False
            folder, places = f"data/{uuid.uuid4().hex}", dict(old["buckets"])
            if touched:
                rows = change(self._rows(old, touched), batch).withColumn("_bucket", self.bucket())
                rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
                for b in touched:
                    fs, p = self._file(f"{folder}/_bucket={b}")
                    places.pop(str(b), None)
                    if fs.exists(p):
                        places[str(b)] = f"{folder}/_bucket={b}"
            version = old["version"] + 1
            if self._create(version, {"version": version, "buckets": places, "batches": old["batches"] | {query: batch_id}}):
                return True
        raise PySparkException(f"{TRIES} other writers came first")


def upsert(key: str, order: list[str]) -> Change:
    """The batch's rows replace rows of their key; of several in a batch the last by `order`."""

    def change(current: DataFrame, batch: DataFrame) -> DataFrame:
        newest = store.latest(batch, [key], order).select(*current.columns)
        return current.join(newest.select(key), key, "left_anti").unionByName(newest)

    return change


def patched(key: str, columns: list[str], order: list[str], fallback: Callable[[DataFrame], DataFrame] | None = None) -> Change:
    """Field-level patches (columns and has_<column>), those of one key in a batch folded in their order."""

    def change(current: DataFrame, batch: DataFrame) -> DataFrame:
        last = [F.max_by(F.col(c), F.when(F.col(f"has_{c}"), F.struct(*order))).alias(c) for c in columns]
        held = [F.coalesce(F.max(f"has_{c}"), F.lit(False)).alias(f"has_{c}") for c in columns]
        one = batch.groupBy(key).agg(*last, *held)
        return store.patch(current, one, key, columns, None, fallback(one).select(*current.columns) if fallback else None)

    return change


def sink(stream: DataFrame, table: Table, change: Change, query: str, checkpoint: str) -> StreamingQuery:
    """Merges a stream into a table, each batch once."""
    return stream.writeStream.queryName(query).foreachBatch(lambda batch, k: table.merge(batch, change, query, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
