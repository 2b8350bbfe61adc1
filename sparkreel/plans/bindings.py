"""Test tables as inputs of the operators, in Spark and (as CTEs) in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import frames as fr



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the frames of one stream per user, with a 64-bit hash that neighbours share."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    base = F.conv(F.substring(F.md5(F.concat_ws("|", "event_type", F.floor(F.col("value") / 25).cast("string")).cast("binary")), 1, 16), 16, -10).cast("long")
    return e.select(
        F.col("user_id").alias("video_id"), (F.row_number().over(order) - 1).cast("int").alias("idx"), X.micros(F.col("ts")).alias("ts_us"),
        (F.col("value") / 250).alias("bm"), (k / 150).alias("dk"), ((F.col("event_id") % 100) / 100).alias("hd"),
        k.alias("k"), base.bitwiseXOR(F.when(k % 3 == 0, F.lit(1)).when(k % 3 == 1, 2).otherwise(4).cast("long")).alias("h"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.classify(metrics(spark, sf_dir))


#: frames, rises and segments as DuckDB CTEs.
FRAMES = """
raw AS (SELECT user_id AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS idx, epoch_us(ts) AS ts_us,
    value / 250e0 AS bm, regexp_extract(props, '([0-9]+)', 1)::INT AS k, (event_id % 100) / 100e0 AS hd,
    ('0x' || substr(md5(event_type || '|' || floor(value / 25e0)::BIGINT), 1, 16))::UBIGINT AS u FROM events),
raw2 AS (SELECT *, k / 150e0 AS dk, xor(CASE WHEN u > 9223372036854775807::UBIGINT THEN (u::HUGEINT - 18446744073709551616)::BIGINT ELSE u::BIGINT END,
    CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END::BIGINT) AS h FROM raw),
frames AS (SELECT video_id, idx, ts_us, idx / 6e0 AS t, bm, dk, hd, k, h, cat, cat = 'loading' AND hd > 0.15e0 AS boundary FROM (SELECT *, CASE WHEN dk > 0.5e0 THEN 'fullscreen_image'
    WHEN bm < 0.02e0 THEN 'loading' WHEN bm < 0.15e0 THEN 'list' ELSE 'detail' END AS cat FROM raw2))"""
SEGMENTS = FRAMES + """,
risen AS (SELECT *, boundary AND NOT lag(boundary, 1, false) OVER (PARTITION BY video_id ORDER BY idx) AS rise FROM frames),
islands AS (SELECT *, sum(rise::INT) OVER (PARTITION BY video_id ORDER BY idx) AS g FROM risen),
segmented AS (SELECT *, (dense_rank() OVER (PARTITION BY video_id ORDER BY g) - 1)::INT AS seg FROM islands WHERE cat <> 'loading')"""
STABLE = SEGMENTS + """,
stable AS (SELECT *, coalesce(bit_count(xor(h, lag(h) OVER (PARTITION BY video_id, seg, cat ORDER BY idx))) <= 2, false) AS stable FROM segmented)"""
CANDIDATES = STABLE + """,
cand AS (SELECT video_id, seg, 'mail' AS kind, 0 AS ord, idx, bm, h, stable AS from_stable FROM stable WHERE cat = 'detail'
    QUALIFY row_number() OVER (PARTITION BY video_id, seg ORDER BY stable DESC, bm DESC, idx) = 1
  UNION ALL SELECT video_id, seg, 'image', 1, idx, bm, h, stable FROM stable WHERE cat = 'fullscreen_image' AND stable)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as correlated frame pairs of one segment per order."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), F.lit(0).alias("seg"), (F.row_number().over(order) - 1).alias("i"),
        (F.col("l_discount") * 200).alias("dx"), (F.col("l_quantity") * 40 - 40).alias("dy"), (1 - F.col("l_tax") * 5).alias("response"),
        (F.col("l_returnflag") == "R").alias("identical"), F.col("l_linenumber").alias("ms"),
    )


PAIRS = """
pairs AS (SELECT l_orderkey AS video_id, 0 AS seg, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1)::INT AS i,
    l_discount * 200 AS dx, l_quantity * 40 - 40 AS dy, 1 - l_tax * 5 AS response, l_returnflag = 'R' AS identical, l_linenumber AS ms FROM lineitem),
why AS (SELECT *, CASE WHEN i = 0 THEN 'first' WHEN identical THEN 'static' WHEN response < 0.7e0 OR abs(dx) > 12 THEN 'weak_or_shift' WHEN dy < 2 THEN 'static' ELSE 'accepted' END AS why FROM pairs),
decided AS (SELECT video_id, seg, i, dx, dy, response, identical, ms, why IN ('first', 'accepted') AS accepted, CASE WHEN why <> 'accepted' THEN why END AS reason,
    CASE why WHEN 'first' THEN 1200 WHEN 'accepted' THEN least(round_even(dy, 0)::INT, 1200 - 154) ELSE 0 END AS add_rows FROM why)"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as exported outputs, one stream per customer; some mails in parts, some repeated or missing time stamps."""
    o = table(spark, sf_dir, "orders")
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    seq = F.row_number().over(order) - 1
    image = F.col("o_orderpriority").startswith("1")
    part = ~image & (F.col("o_orderkey") % 3 == 0)
    return o.select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").alias("video_id"), seq.cast("int").alias("seq"),
        F.when(image, "image").otherwise("mail").alias("kind"), F.floor(seq / 2).cast("int").alias("seg"), (F.col("o_orderkey") % 5 != 0).alias("included"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("2026-01-02_0304")).when(F.col("o_orderkey") % 11 == 0, F.lit("")).alias("edited_ts"),
        F.when(F.year("o_orderdate") >= 2000, F.date_format("o_orderdate", "yyyy-MM-dd_HHmm")).alias("timestamp"),
        F.when(part, seq % 2 + 1).cast("int").alias("part_index"), F.when(part, 2).cast("int").alias("part_total"),
    )


OUTPUTS = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders),
outputs AS (SELECT o_orderkey::VARCHAR AS key, o_custkey AS video_id, n::INT AS seq, CASE WHEN o_orderpriority LIKE '1%' THEN 'image' ELSE 'mail' END AS kind, (n // 2)::INT AS seg, o_orderkey % 5 <> 0 AS included,
    CASE WHEN o_orderkey % 7 = 0 THEN '2026-01-02_0304' WHEN o_orderkey % 11 = 0 THEN '' END AS edited_ts,
    CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d_%H%M') END AS "timestamp",
    CASE WHEN o_orderpriority NOT LIKE '1%' AND o_orderkey % 3 = 0 THEN n % 2 + 1 END::INT AS part_index, CASE WHEN o_orderpriority NOT LIKE '1%' AND o_orderkey % 3 = 0 THEN 2 END::INT AS part_total FROM numbered)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as jobs of the store."""
    o = table(spark, sf_dir, "orders")
    ms = (X.micros(F.col("o_orderdate")) / 1000).cast("long")
    return o.select(
        F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("tab-"), (F.col("o_custkey") % 50).cast("string")).alias("owner_id"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit(0)).when(F.col("o_orderkey") % 17 != 0, ms + F.col("o_orderkey") % 600_000).cast("long").alias("heartbeat_at"),
        F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "done").otherwise("failed").alias("status"),
        ms.alias("created_at"), (ms + F.col("o_custkey") * 1000).alias("updated_at"),
    )


JOBS = """
jobs AS (SELECT 'job-' || o_orderkey AS id, 'tab-' || (o_custkey % 50) AS owner_id, CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 17 <> 0 THEN epoch_ms(o_orderdate) + o_orderkey % 600000 END::BIGINT AS heartbeat_at,
    CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'done' ELSE 'failed' END AS status, epoch_ms(o_orderdate)::BIGINT AS created_at, (epoch_ms(o_orderdate) + o_custkey * 1000)::BIGINT AS updated_at FROM orders)"""


def sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 64-bit sign hashes, first dimension highest."""
    h = F.expr("aggregate(embedding, 0L, (acc, x) -> shiftleft(acc, 1) | if(x > 0, 1L, 0L))")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", h.alias("h"))


SIGN_HASHES = """
signs AS (SELECT vec_id, label, (list_reduce(list_transform(embedding[2:], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END::BIGINT), lambda a, b: a * 2 + b, 0::BIGINT)
    + CASE WHEN embedding[1] > 0 THEN -9223372036854775808 ELSE 0 END)::BIGINT AS h FROM embeddings)"""


def near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of eight hashes (vec_id, label, h): the first one's sign hash with four bits flipped, by the id, so that some pairs are within the production distance and some are not."""
    s = sign_hashes(spark, sf_dir)
    first = s.select(F.col("vec_id").alias("_first"), "label", "h")
    flip = " ^ ".join(f"shiftleft(1L, cast(vec_id * {a} % {b} as int))" for a, b in _FLIPS)
    return s.select("vec_id", (F.col("vec_id") - F.col("vec_id") % 8).alias("_first")).join(first, "_first").select("vec_id", "label", F.expr(f"h ^ {flip}").alias("h"))


_FLIPS = ((1, 61), (7, 59), (11, 53), (13, 47))
NEAR_HASHES = SIGN_HASHES + """,
near AS (SELECT s.vec_id, f.label, xor(xor(xor(xor(f.h, {0}), {1}), {2}), {3}) AS h FROM signs s JOIN signs f ON f.vec_id = s.vec_id - s.vec_id % 8)""".format(*[f"1::BIGINT << (s.vec_id * {a} % {b})::INT" for a, b in _FLIPS])


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 gray images and their channel values."""
    px = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") * 2.0 + 0.5) * 255).cast("int"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", px.alias("px"))


PIXELS = """
pixels AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE * 2e0 + 0.5e0) * 255)::INT))) AS px FROM embeddings)"""
