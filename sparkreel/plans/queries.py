"""The library's queries over the test tables, each with DuckDB SQL of the same result.

A key begins with the id of its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X
from ..operators import frames as fr
from ..operators import naming, ocr, select, stitching, store
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- classification and segmentation -------------------------------------------------


@query(f"WITH {B.FRAMES} SELECT video_id, idx::BIGINT AS idx, t, bm, dk, hd, cat, boundary FROM frames")
def p11_classify(spark, sf_dir):
    return B.frames(spark, sf_dir).select("video_id", *_long("idx"), "t", "bm", "dk", "hd", "cat", "boundary")


@query(f"WITH {B.FRAMES} SELECT cat, boundary, count(*)::BIGINT AS n FROM frames GROUP BY ALL")
def p09_p10_category_counts(spark, sf_dir):
    return B.frames(spark, sf_dir).groupBy("cat", "boundary").agg(F.count("*").alias("n"))


@query(f"WITH {B.FRAMES} SELECT video_id, idx::BIGINT AS idx, cat FROM frames WHERE cat <> 'loading'")
def p12_without_loading(spark, sf_dir):
    return B.frames(spark, sf_dir).where("cat <> 'loading'").select("video_id", *_long("idx"), "cat")


@query(f"WITH {B.FRAMES} SELECT video_id, idx::BIGINT AS idx, bm FROM frames WHERE cat = 'detail'")
def p13_detail_frames(spark, sf_dir):
    return B.frames(spark, sf_dir).where("cat = 'detail'").select("video_id", *_long("idx"), "bm")


@query(f"WITH {B.SEGMENTS} SELECT video_id, idx::BIGINT AS idx FROM risen WHERE rise")
def w1_rises(spark, sf_dir):
    return fr.rises(B.frames(spark, sf_dir)).where("rise").select("video_id", *_long("idx"))


@query(f"WITH {B.SEGMENTS} SELECT video_id, idx::BIGINT AS idx, seg::BIGINT AS seg, cat FROM segmented")
def w2_segments(spark, sf_dir):
    return fr.segments(B.frames(spark, sf_dir)).select("video_id", *_long("idx", "seg"), "cat")


_SUMMARY = B.SEGMENTS + """,
summary AS (SELECT video_id, seg, min(idx) AS idx_start, max(idx) AS idx_end, min(t) AS t_start, max(t) AS t_end, count_if(cat = 'list') AS n_list, count_if(cat = 'loading') AS n_loading,
    count_if(cat = 'detail') AS n_detail, count_if(cat = 'fullscreen_image') AS n_fullscreen_image FROM segmented GROUP BY ALL)"""


@query(f"""WITH {_SUMMARY} SELECT video_id, seg::BIGINT AS seg, idx_start::BIGINT AS idx_start, idx_end::BIGINT AS idx_end, t_start, t_end, n_list::BIGINT AS n_list,
    n_loading::BIGINT AS n_loading, n_detail::BIGINT AS n_detail, n_fullscreen_image::BIGINT AS n_fullscreen_image FROM summary""")
def a1_segment_summary(spark, sf_dir):
    s = fr.summarize(fr.segments(B.frames(spark, sf_dir)))
    return s.select("video_id", *_long("seg", "idx_start", "idx_end"), "t_start", "t_end", *_long("n_list", "n_loading", "n_detail", "n_fullscreen_image"))


@query(f"""WITH {_SUMMARY} SELECT video_id, boundary_rises::BIGINT AS boundary_rises, coalesce(segments, 0)::BIGINT AS segments, coalesce(mail_segments, 0)::BIGINT AS mail_segments
  FROM (SELECT video_id, count_if(rise) AS boundary_rises FROM risen GROUP BY ALL) LEFT JOIN (SELECT video_id, count(*) AS segments, count_if(n_detail > 0) AS mail_segments FROM summary GROUP BY ALL) USING (video_id)""")
def a2_video_totals(spark, sf_dir):
    f = B.frames(spark, sf_dir)
    return fr.totals(f, fr.summarize(fr.segments(f)))


@query("""WITH e AS (SELECT user_id AS video_id, event_id, epoch_us(ts) AS ts_us, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT *, floor((ts_us - t0)::DOUBLE * 4.62962962962963e-05 / 1e6 + 0.5e0 + 1e-4)::BIGINT AS r, floor((ts_us + 21600000000 - t0)::DOUBLE * 4.62962962962963e-05 / 1e6 + 0.5e0 + 1e-4)::BIGINT AS e FROM e),
m AS (SELECT *, max(r) OVER w AS rm FROM s WINDOW w AS (PARTITION BY video_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, coalesce(lead(rm) OVER (PARTITION BY video_id ORDER BY n), e) AS upto FROM m)
SELECT video_id, event_id, unnest(range(rm, upto))::BIGINT AS slot FROM l WHERE upto > rm""")
def j1_resample(spark, sf_dir):
    """One slot per six hours: gaps repeat an event, events of one slot give way to the last."""
    rate = 4.62962962962963e-05
    e = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", X.micros(F.col("ts")).alias("ts_us"), "ts")
    e = e.withColumn("n", F.row_number().over(W.partitionBy("video_id").orderBy("ts", "event_id"))).withColumn("t0", F.min("ts_us").over(W.partitionBy("video_id")))
    out = fr.resample(e, X.slot_of(F.col("ts_us"), F.col("t0"), rate), X.slot_of(F.col("ts_us") + 21_600_000_000, F.col("t0"), rate))
    return out.select("video_id", "event_id", "slot")


@query("""SELECT user_id AS video_id, event_id FROM (SELECT *, max(event_id % 97) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)
WHERE m IS NULL OR event_id % 97 > m""")
def w8_s3_monotone_samples(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", (F.col("event_id") % 97).alias("number"), F.struct("ts", "event_id").alias("at"))
    return fr.monotone(e, "number", "at").select("video_id", "event_id")


@query("SELECT o_orderkey, floor((o_orderkey % 40) * 3 * 6e0 + 0.5e0)::BIGINT + o_custkey % 18 AS slot FROM orders")
def s6_chunk_slots(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.chunk_slot(F.col("o_orderkey") % 40 * 3, F.lit(6.0), F.col("o_custkey") % 18).alias("slot"))


# --- selection ------------------------------------------------------------------------


@query(f"WITH {B.STABLE} SELECT video_id, seg::BIGINT AS seg, cat, idx::BIGINT AS idx, stable FROM stable")
def w3_stability(spark, sf_dir):
    return select.stability(fr.segments(B.frames(spark, sf_dir))).select("video_id", *_long("seg"), "cat", *_long("idx"), "stable")


@query(f"""WITH {B.STABLE} SELECT video_id, seg::BIGINT AS seg, idx::BIGINT AS idx, bm, stable FROM stable WHERE cat = 'detail'
QUALIFY row_number() OVER (PARTITION BY video_id, seg ORDER BY stable DESC, bm DESC, idx) = 1""")
def o4_a3_representatives(spark, sf_dir):
    s = select.stability(fr.segments(B.frames(spark, sf_dir)))
    return select.representatives(s).select("video_id", *_long("seg", "idx"), "bm", "stable")


_FOLD = "list_reduce(list_transform(all_, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: bit_count(xor(y.h, x[1].h)) <= {r})) > 0 THEN acc ELSE list_concat(acc, x) END)"


@query(f"""WITH {B.CANDIDATES}, folded AS (SELECT video_id, list(struct_pack(seg := seg, ord := ord, idx := idx, h := h) ORDER BY seg, ord, idx) AS all_ FROM cand GROUP BY ALL),
kept AS (SELECT video_id, unnest({_FOLD.format(r=6)}) AS k FROM folded)
SELECT c.video_id, c.seg::BIGINT AS seg, c.kind, c.idx::BIGINT AS idx, c.bm, c.from_stable, CASE WHEN k.video_id IS NULL THEN 'skipped' ELSE 'selected' END AS event,
  CASE WHEN k.video_id IS NULL THEN 'duplicate' END AS reason FROM cand c LEFT JOIN kept k ON c.video_id = k.video_id AND c.seg = k.k.seg AND c.ord = k.k.ord AND c.idx = k.k.idx""")
def h10_select_events(spark, sf_dir):
    s = select.stability(fr.segments(B.frames(spark, sf_dir)))
    return select.select_events(s).select("video_id", *_long("seg"), "kind", *_long("idx"), "bm", "from_stable", "event", "reason")


@query()
def h09_h10_select_events_held(spark, sf_dir):
    """The streaming rule with held images and overflow; the tests judge the same frames one by one."""
    return select.select_events_held(select.stability(fr.segments(B.frames(spark, sf_dir))))


@query(f"""WITH {B.NEAR_HASHES}, folded AS (SELECT label, list(struct_pack(vec_id := vec_id, h := h) ORDER BY vec_id) AS all_ FROM near GROUP BY ALL),
kept AS (SELECT label, unnest({_FOLD.format(r=6)}) AS k FROM folded)
SELECT s.label::BIGINT AS label, s.vec_id, k.label IS NOT NULL AS kept FROM near s LEFT JOIN kept k ON s.label = k.label AND s.vec_id = k.k.vec_id""")
def j2_greedy_dedup(spark, sf_dir):
    g = select.greedy(B.near_hashes(spark, sf_dir), ["label"], ["vec_id"], "h", K.DUP_DISTANCE)
    return g.select(F.col("label").cast("long").alias("label"), "vec_id", "kept")


@query(f"WITH {B.NEAR_HASHES} SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM near a JOIN near b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 6")
def j2_hamming_pairs(spark, sf_dir):
    e = select.candidate_edges(B.near_hashes(spark, sf_dir), "vec_id", "h", K.DUP_DISTANCE)
    return e.select("a", "b", F.col("distance").cast("long").alias("distance"))


@query(f"""WITH {B.STABLE}, images AS (SELECT video_id, seg, idx, h FROM stable WHERE cat = 'fullscreen_image' AND stable),
folded AS (SELECT video_id, seg, list(struct_pack(idx := idx, h := h) ORDER BY idx) AS all_ FROM images GROUP BY ALL),
kept AS (SELECT video_id, seg, unnest({_FOLD.format(r=6)}) AS k FROM folded)
SELECT video_id, seg::BIGINT AS seg, k.idx::BIGINT AS idx, row_number() OVER (PARTITION BY video_id, seg ORDER BY k.idx) > 1 AS overflow FROM kept""")
def o5_pending_images(spark, sf_dir):
    """With a limit of one held image, so that both outcomes occur."""
    s = select.stability(fr.segments(B.frames(spark, sf_dir))).where("cat = 'fullscreen_image' and stable")
    return select.pending(s, limit=1).select("video_id", *_long("seg", "idx"), "overflow")


@query(f"""WITH {B.CANDIDATES} SELECT video_id, seg::BIGINT AS seg, kind, idx::BIGINT AS idx, row_number() OVER (PARTITION BY video_id ORDER BY seg, ord, idx)::BIGINT AS place FROM cand""")
def o9_event_order(spark, sf_dir):
    c = select.candidates(select.stability(fr.segments(B.frames(spark, sf_dir))))
    place = F.row_number().over(W.partitionBy("video_id").orderBy("seg", "ord", "idx")).cast("long")
    return c.select("video_id", *_long("seg"), "kind", *_long("idx"), place.alias("place"))


# --- hashes ---------------------------------------------------------------------------


@query(f"WITH {B.SIGN_HASHES} SELECT vec_id, h, lower(lpad(to_hex(h), 16, '0')) AS hex, h AS back FROM signs")
def h7_hex_round_trip(spark, sf_dir):
    s = B.sign_hashes(spark, sf_dir).withColumn("hex", X.hash_to_hex(F.col("h")))
    return s.select("vec_id", "h", "hex", X.hash_from_hex(F.col("hex")).alias("back"))


@query(f"WITH {B.SIGN_HASHES} SELECT vec_id, bit_count(xor(h, lag(h) OVER (PARTITION BY label ORDER BY vec_id)))::BIGINT AS distance FROM signs")
def h6_hamming(spark, sf_dir):
    near = F.lag("h").over(W.partitionBy("label").orderBy("vec_id"))
    return B.sign_hashes(spark, sf_dir).select("vec_id", X.hamming(F.col("h"), near).cast("long").alias("distance"))


@query("SELECT doc_id, text = lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS identical FROM documents")
def h8_j4_identical(spark, sf_dir):
    """Neighbours in a source; digests are compared, so no text is shuffled."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return d.select("doc_id", (F.col("digest") == F.lag("digest").over(W.partitionBy("source").orderBy("doc_id"))).alias("identical"))


@query(f"WITH {B.SIGN_HASHES} SELECT label::BIGINT AS label, median(bit_count(h))::DOUBLE AS median_bits FROM signs GROUP BY ALL")
def a4_median(spark, sf_dir):
    return B.sign_hashes(spark, sf_dir).groupBy(F.col("label").cast("long").alias("label")).agg(F.median(F.bit_count("h")).alias("median_bits"))


# --- pixels ---------------------------------------------------------------------------


@query(f"""WITH {B.PIXELS} SELECT vec_id, ((px[1] * 19595 + px[2] * 38470 + px[3] * 7471 + 32768) >> 16)::BIGINT AS gray, ((px[1] * 4899 + px[2] * 9617 + px[3] * 1868 + 8192) >> 14)::BIGINT AS gray_cv FROM pixels""")
def p1_p2_gray(spark, sf_dir):
    p = B.pixels(spark, sf_dir)
    r, g, b = F.col("px")[0], F.col("px")[1], F.col("px")[2]
    return p.select("vec_id", X.gray_pillow(r, g, b).cast("long").alias("gray"), X.gray_cv(r, g, b).cast("long").alias("gray_cv"))


@query("SELECT o_orderkey, trunc((o_orderkey % 4000)::DOUBLE * 0.145e0)::BIGINT AS top, trunc((o_orderkey % 4000)::DOUBLE * 0.19e0)::BIGINT AS bottom FROM orders")
def p3_band_rows(spark, sf_dir):
    h = F.col("o_orderkey") % 4000
    return B.table(spark, sf_dir, "orders").select("o_orderkey", *[X.band_edge(h, p).cast("long").alias(n) for n, p in zip(("top", "bottom"), K.AVATAR_Y, strict=True)])


@query(f"""WITH {B.PIXELS} SELECT vec_id, len(list_filter(px[17:56], lambda p: p < 240)) / 40e0 AS bm,
 (len(list_filter(px[1:8], lambda p: p < 60)) + len(list_filter(px[57:56], lambda p: p < 60))) / 8e0 AS dk FROM pixels""")
def p4_p6_metrics(spark, sf_dir):
    """8 x 8 images: the body band is rows 2 to 6, the dark bands are row 0 and none."""
    p, n = B.pixels(spark, sf_dir), F.lit(8)
    return p.select("vec_id", X.body_metric(F.col("px"), n, n).alias("bm"), X.darkness(F.col("px"), n, n).alias("dk"))


@query(f"""WITH {B.PIXELS} SELECT vec_id, (greatest(px[1], px[2], px[3]) - least(px[1], px[2], px[3])) * 5 > greatest(px[1], px[2], px[3]) AS saturated FROM pixels""")
def p7_saturated(spark, sf_dir):
    return B.pixels(spark, sf_dir).select("vec_id", X.is_saturated(F.col("px")[0], F.col("px")[1], F.col("px")[2]).alias("saturated"))


@query(f"""WITH {B.PIXELS}, two AS (SELECT p.vec_id, px AS a, lag(px) OVER (PARTITION BY label ORDER BY p.vec_id) AS b FROM pixels p JOIN embeddings e ON e.vec_id = p.vec_id)
SELECT vec_id, list_sum(list_transform(range(1, 9), lambda i: abs(a[i] - b[i]))) / 8e0 AS first_row, list_sum(list_transform(range(57, 65), lambda i: abs(a[i] - b[i]))) / 8e0 AS last_row FROM two WHERE b IS NOT NULL""")
def a8_j4_row_differences(spark, sf_dir):
    p = B.pixels(spark, sf_dir)
    d = p.withColumn("before", F.lag("px").over(W.partitionBy("label").orderBy("vec_id"))).where("before is not null")
    d = d.withColumn("d", stitching.row_diff(F.col("px"), F.col("before"), F.lit(8)))
    return d.select("vec_id", F.col("d")[0].alias("first_row"), F.col("d")[7].alias("last_row"))


@query("""WITH d AS (SELECT o_orderkey, list_transform(range(0, 8), lambda i: CASE WHEN i < o_orderkey % 9 THEN 0.5e0 ELSE 2e0 END) AS d FROM orders)
SELECT o_orderkey, least(coalesce(list_position(list_transform(d, lambda x: x >= 1), true) - 1, 8), 2)::BIGINT AS est FROM d""")
def g9_fixed_rows(spark, sf_dir):
    d = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < F.col("o_orderkey") % 9, 0.5).otherwise(2.0))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", stitching.estimate_fixed_rows(d, F.lit(8)).cast("long").alias("est"))


@query("""WITH sizes AS (SELECT DISTINCT (power(2, a) * power(3, b) * power(5, c))::BIGINT AS s FROM range(18) t(a), range(12) u(b), range(8) v(c) WHERE power(2, a) * power(3, b) * power(5, c) <= 65536),
n AS (SELECT DISTINCT o_orderkey % 5000 + 1 AS n FROM orders) SELECT n, min(s) AS size FROM n JOIN sizes ON s >= n GROUP BY ALL""")
def g1_dft_size(spark, sf_dir):
    n = B.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5000 + 1).alias("n")).distinct()
    return n.select("n", X.optimal_dft_size(F.col("n")).cast("long").alias("size"))


# --- stitching ------------------------------------------------------------------------


def _decided(spark, sf_dir):
    return stitching.decide(B.pairs(spark, sf_dir), F.lit(1200), F.lit(154))


@query(f"WITH {B.PAIRS} SELECT video_id, i::BIGINT AS i, dx, dy, response, accepted, reason, add_rows::BIGINT AS add_rows FROM decided")
def g10_g12_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("video_id", *_long("i"), "dx", "dy", "response", "accepted", "reason", *_long("add_rows"))


@query(f"WITH {B.PAIRS} SELECT video_id, i::BIGINT AS i, (sum(add_rows) OVER w - add_rows)::BIGINT AS dst_row, (sum(add_rows) OVER w)::BIGINT AS canvas FROM decided WINDOW w AS (PARTITION BY video_id ORDER BY i)")
def w5_placement(spark, sf_dir):
    return stitching.place(_decided(spark, sf_dir)).select("video_id", *_long("i", "dst_row", "canvas"))


@query(f"WITH {B.PAIRS} SELECT video_id, count_if(accepted AND i > 0)::BIGINT AS accepted, CASE WHEN count_if(accepted AND i > 0) > 0 THEN sum(add_rows) END::BIGINT AS height FROM decided GROUP BY ALL")
def g15_closed(spark, sf_dir):
    return stitching.closed(_decided(spark, sf_dir)).select("video_id", *_long("accepted", "height"))


@query(f"""WITH RECURSIVE {B.PAIRS}, fold(video_id, i, rows_, truncated) AS (
  SELECT video_id, 0, least(add_rows, 2500)::BIGINT, (add_rows - least(add_rows, 2500))::BIGINT FROM decided WHERE i = 0
  UNION ALL SELECT d.video_id, d.i, CASE WHEN rows_ + add_rows <= 2500 THEN rows_ + add_rows ELSE rows_ END, CASE WHEN rows_ + add_rows <= 2500 THEN truncated ELSE truncated + add_rows END
  FROM fold f JOIN decided d ON d.video_id = f.video_id AND d.i = f.i + 1)
SELECT video_id, rows_ AS height, truncated AS truncated_rows FROM fold QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY i DESC) = 1""")
def g14_capped_canvas(spark, sf_dir):
    return stitching.capped(_decided(spark, sf_dir), F.lit(2500)).select("video_id", *_long("height", "truncated_rows"))


@query(f"""WITH {B.PAIRS}, c AS (SELECT video_id, sum(add_rows) AS height FROM decided GROUP BY ALL)
SELECT video_id, unnest(range(1, ceil(height / 2000e0)::BIGINT + 1)) AS part_index, ceil(height / 2000e0)::BIGINT AS part_total, (part_index - 1) * 2000 AS part_row, least(2000, height - (part_index - 1) * 2000)::BIGINT AS part_rows FROM c""")
def s11_export_parts(spark, sf_dir):
    """Parts of 2000 rows, so that canvases have several."""
    c = _decided(spark, sf_dir).groupBy("video_id").agg(F.sum("add_rows").alias("height"))
    return stitching.parts(c, limit=2000).select("video_id", *_long("part_index", "part_total", "part_row", "part_rows"))


@query(f"""WITH {B.PAIRS} SELECT video_id, i::BIGINT AS i, coalesce(min(CASE WHEN accepted AND response >= 0.8e0 THEN 100 + (dy::BIGINT % 90) END) OVER (PARTITION BY video_id ORDER BY i), 154)::BIGINT AS skip FROM decided""")
def w6_running_fixed_rows(spark, sf_dir):
    est = F.when(F.col("accepted") & (F.col("response") >= K.FIXED_ROW_RESPONSE), F.col("dy").cast("long") % 90 + 100)
    return stitching.fixed_rows(_decided(spark, sf_dir).withColumn("est", est), F.lit(154)).select("video_id", *_long("i", "skip"))


@query(f"WITH {B.PAIRS} SELECT video_id, i::BIGINT AS i, response >= 0.55e0 AND response < 0.85e0 AS recheck FROM pairs")
def g10_recheck(spark, sf_dir):
    return B.pairs(spark, sf_dir).select("video_id", *_long("i"), stitching.needs_recheck(F.col("response")).alias("recheck"))


@query(f"WITH {B.PAIRS} SELECT video_id, coalesce(sum(ms) / nullif(count(ms), 0), 0)::DOUBLE AS ms FROM pairs GROUP BY ALL")
def a7_ms_per_frame(spark, sf_dir):
    return B.pairs(spark, sf_dir).groupBy("video_id").agg(stitching.ms_per_frame(F.col("ms")).alias("ms"))


@query("SELECT o_orderkey, round_even(o_totalprice / 2, 0)::BIGINT AS half, least(round_even(o_totalprice / 2, 0)::BIGINT, 1046)::BIGINT AS added FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def g11_g12_rounding(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice") / 2).alias("dy"))
    return o.select("o_orderkey", X.round_half_even(F.col("dy")).cast("long").alias("half"), X.added_rows(F.col("dy"), F.lit(1200), F.lit(154)).cast("long").alias("added"))


@query("SELECT o_orderkey, greatest(1, floor(134217728 / ((o_orderkey % 3000 + 1) * 4e0)))::BIGINT AS rows_ FROM orders")
def f14_max_rows(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select("o_orderkey", X.max_rows(F.col("o_orderkey") % 3000 + 1).alias("rows_"))


# --- recognition attempts -------------------------------------------------------------

_SPACED = """
fold(video_id, seg, n, idx, last_) AS (
  SELECT video_id, seg, n, idx, idx FROM det WHERE n = 1
  UNION ALL SELECT d.video_id, d.seg, d.n, d.idx, CASE WHEN d.idx - f.last_ >= 3 THEN d.idx ELSE f.last_ END FROM fold f JOIN det d ON d.video_id = f.video_id AND d.seg = f.seg AND d.n = f.n + 1),
taken AS (SELECT video_id, seg, idx, row_number() OVER (PARTITION BY video_id, seg ORDER BY idx)::INT AS attempt FROM fold WHERE last_ = idx)"""
_DET = B.SEGMENTS + ", det AS (SELECT video_id, seg, idx, row_number() OVER (PARTITION BY video_id, seg ORDER BY idx) AS n FROM segmented WHERE cat = 'detail')," + _SPACED


def _tried(spark, sf_dir):
    taken = ocr.attempts(ocr.spaced(fr.segments(B.frames(spark, sf_dir)).where("cat = 'detail'")))
    stamp = F.when((F.col("idx") * 7 + F.col("video_id")) % 5 == 0, F.format_string("2026-01-%02d_1200", F.col("seg") % 28 + 1))
    return taken.withColumns({"timestamp": stamp, "error": (F.col("idx") + F.col("video_id")) % 4 == 0})


_TRIED = _DET + """,
tried AS (SELECT *, CASE WHEN (idx * 7 + video_id) % 5 = 0 THEN printf('2026-01-%02d_1200', seg % 28 + 1) END AS stamp, (idx + video_id) % 4 = 0 AS error FROM taken WHERE attempt <= 8),
ran AS (SELECT * FROM (SELECT *, max((stamp IS NOT NULL AND NOT error)::INT) OVER (PARTITION BY video_id, seg ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM tried) WHERE coalesce(done, 0) = 0),
lagged AS (SELECT *, error AND coalesce(lag(error, 1) OVER w, false) AND coalesce(lag(error, 2) OVER w, false) AS third FROM ran WINDOW w AS (PARTITION BY video_id ORDER BY seg, attempt)),
runs AS (SELECT * FROM (SELECT *, max(third::INT) OVER (PARTITION BY video_id ORDER BY seg, attempt) AS stopped FROM lagged) WHERE stopped = 0)"""


@query(f"WITH RECURSIVE {_DET} SELECT video_id, seg::BIGINT AS seg, idx::BIGINT AS idx FROM taken")
def w7_spaced_candidates(spark, sf_dir):
    return ocr.spaced(fr.segments(B.frames(spark, sf_dir)).where("cat = 'detail'")).select("video_id", *_long("seg", "idx"))


@query(f"WITH RECURSIVE {_TRIED} SELECT video_id, seg::BIGINT AS seg, idx::BIGINT AS idx, attempt::BIGINT AS attempt, error FROM runs")
def r3_r6_o8_attempts(spark, sf_dir):
    return ocr.outcomes(_tried(spark, sf_dir)).select("video_id", *_long("seg", "idx", "attempt"), "error")


@query(f"""WITH RECURSIVE {_TRIED} SELECT video_id, seg::BIGINT AS seg, count(*)::BIGINT AS attempts, max(stamp IS NOT NULL AND NOT error) AS found,
  min(CASE WHEN NOT error THEN stamp END) AS "timestamp" FROM runs GROUP BY ALL""")
def o6_a6_results(spark, sf_dir):
    return ocr.results(ocr.outcomes(_tried(spark, sf_dir))).select("video_id", *_long("seg", "attempts"), "found", "timestamp")


# --- text -----------------------------------------------------------------------------

_TEXTS = """texts AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'Sent ' || strftime(ts, '%Y-%m-%d %H:%M') || ' x' WHEN 1 THEN strftime(ts, '%Y-%m-%d%H%M') WHEN 2 THEN '2026-02-31 10:00 2026-03-01 11:00'
  WHEN 3 THEN strftime(ts, '%Y/%m/%d') WHEN 4 THEN '2026-01-01 24:' || strftime(ts, '%M') ELSE strftime(ts, '%y-%m-%d %H:%M') END AS s FROM events)"""


def _texts(spark, sf_dir):
    e, m = B.table(spark, sf_dir, "events"), F.col("event_id") % 6
    d = lambda p: F.date_format("ts", p)
    s = F.when(m == 0, F.concat(F.lit("Sent "), d("yyyy-MM-dd HH:mm"), F.lit(" x"))).when(m == 1, d("yyyy-MM-ddHHmm")).when(m == 2, F.lit("2026-02-31 10:00 2026-03-01 11:00"))
    s = s.when(m == 3, d("yyyy/MM/dd")).when(m == 4, F.concat(F.lit("2026-01-01 24:"), d("mm"))).otherwise(d("yy-MM-dd HH:mm"))
    return e.select(F.col("event_id").alias("id"), s.alias("s"))


@query(f"""WITH {_TEXTS}, p AS (SELECT id, regexp_extract(s, '(20[0-9][0-9])-([0-9][0-9])-([0-9][0-9])\\s*([0-9][0-9]):?([0-9][0-9])', ['y', 'm', 'd', 'h', 'i']) AS g FROM texts)
SELECT id, CASE WHEN g.y <> '' AND try_cast(g.y || '-' || g.m || '-' || g.d AS DATE) IS NOT NULL AND try_cast(g.h AS INT) < 24 AND try_cast(g.i AS INT) < 60 THEN g.y || '-' || g.m || '-' || g.d || '_' || g.h || g.i END AS ts,
  CASE WHEN g.y <> '' AND try_cast(g.y || '-' || g.m || '-' || g.d AS DATE) IS NOT NULL AND try_cast(g.h AS INT) < 24 AND try_cast(g.i AS INT) < 60 THEN g.y || '-' || g.m || '-' || g.d || ' ' || g.h || ':' || g.i END AS shown FROM p""")
def f1_f3_timestamps(spark, sf_dir):
    t = _texts(spark, sf_dir).withColumn("ts", X.parse_timestamp(F.col("s")))
    return t.select("id", "ts", X.format_timestamp(F.col("ts")).alias("shown"))


@query("""SELECT o_orderkey, (o_orderkey % 14) BETWEEN 1 AND 12 AND try_cast((2000 + o_orderkey % 30)::VARCHAR || '-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_custkey % 33)::VARCHAR, 2, '0') AS DATE) IS NOT NULL
  AND o_custkey % 25 < 24 AND o_orderkey % 61 < 60 AS ok FROM orders""")
def f2_valid_date_time(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = [(x).cast("int") for x in (2000 + k % 30, k % 14, c % 33, c % 25, k % 61)]
    return B.table(spark, sf_dir, "orders").select("o_orderkey", X.valid_date_time(*parts).alias("ok"))


@query("""WITH typed AS (SELECT o_orderkey, ' ' || year(o_orderdate) || CASE o_orderkey % 3 WHEN 0 THEN '-' ELSE '/' END || month(o_orderdate) || '/' || (o_orderkey % 33) || CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'T' WHEN 2 THEN '_' ELSE '' END || (o_orderkey % 26) || CASE o_orderkey % 2 WHEN 0 THEN ':' ELSE '' END || lpad((o_custkey % 62)::VARCHAR, 2, '0') AS s FROM orders),
p AS (SELECT o_orderkey, regexp_extract(s, '^\\s*([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})[\\sT_]*([0-9]{1,2}):?([0-9]{2})\\s*$', ['y', 'm', 'd', 'h', 'i']) AS g FROM typed)
SELECT o_orderkey, CASE WHEN g.y <> '' AND try_cast(g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') AS DATE) IS NOT NULL AND try_cast(g.h AS INT) < 24 AND try_cast(g.i AS INT) < 60
  THEN g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') || '_' || lpad(g.h, 2, '0') || g.i END AS ts FROM p""")
def f4_typed_timestamps(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = F.concat(F.lit(" "), F.year("o_orderdate"), F.when(k % 3 == 0, "-").otherwise("/"), F.month("o_orderdate"), F.lit("/"), k % 33, F.when(k % 4 == 0, " ").when(k % 4 == 1, "T").when(k % 4 == 2, "_").otherwise(""), k % 26, F.when(k % 2 == 0, ":").otherwise(""), F.format_string("%02d", c % 62))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", X.normalize_timestamp(s).alias("ts"))


@query(r"""SELECT conv_id, turn, nullif(trim(regexp_replace(regexp_replace(regexp_replace(' ' || text || '|_ ', '[\r\n]+', ' ', 'g'), '[|\\/_~`^]+', '', 'g'), '\s+', ' ', 'g')), '') AS sender FROM conversations""")
def f5_clean_sender(spark, sf_dir):
    """Texts without CJK characters; those are in the unit tests, as RE2 cannot look around."""
    c = B.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", X.clean_sender(F.concat(F.lit(" "), F.col("text"), F.lit("|_ "))).alias("sender"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'mail_' || strftime(o_orderdate, '%Y-%m-%d_%H%M') ELSE printf('mail_unknown_%02d', o_orderkey % 150) END || CASE WHEN o_orderkey % 3 > 0 THEN '_' || (o_orderkey % 3 + 1) ELSE '' END || '.png' AS mail,
  printf('image_%03d.png', o_orderkey % 1500) AS image, 'v.' || (o_orderkey % 7) AS video FROM orders""")
def f6_f7_f10_file_names(spark, sf_dir):
    k = F.col("o_orderkey")
    ts = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd_HHmm"))
    return B.table(spark, sf_dir, "orders").select(
        "o_orderkey", X.mail_file(ts, k % 150, k % 3).alias("mail"), X.image_file(k % 1500).alias("image"),
        X.stem(F.concat(F.lit("v."), (k % 7).cast("string"), F.lit(".mp4"))).alias("video"),
    )


@query("""WITH n AS (SELECT o_orderkey, 'rec_' || o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' WHEN 2 THEN '.m4v' WHEN 3 THEN '.png' ELSE '' END AS name, CASE WHEN o_orderkey % 7 = 0 THEN 'video/quicktime' WHEN o_orderkey % 7 = 1 THEN 'image/png' END AS mime FROM orders)
SELECT o_orderkey, name FROM n WHERE regexp_matches(lower(name), '\\.(mp4|mov|m4v)$') OR coalesce(starts_with(mime, 'video/'), false)""")
def s1_file_intake(spark, sf_dir):
    k = F.col("o_orderkey")
    ext = F.when(k % 5 == 0, ".mp4").when(k % 5 == 1, ".MOV").when(k % 5 == 2, ".m4v").when(k % 5 == 3, ".png").otherwise("")
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("rec_"), k.cast("string"), ext).alias("name"), F.when(k % 7 == 0, "video/quicktime").when(k % 7 == 1, "image/png").alias("mime"))
    return o.where(X.accepts_file(F.col("name"), F.col("mime"))).select("o_orderkey", "name")


# --- naming and export ----------------------------------------------------------------

_NAMED = B.OUTPUTS + """,
inc AS (SELECT *, nullif(coalesce(edited_ts, "timestamp"), '') AS ts FROM outputs WHERE included),
heads AS (SELECT *, kind = 'mail' AND (part_index IS NULL OR part_index <= 1 OR row_number() OVER (PARTITION BY video_id, kind, seg, part_index IS NULL ORDER BY seq) = 1) AS head FROM inc),
counted AS (SELECT *, sum(head::INT) OVER w AS mail_n, sum((kind = 'image')::INT) OVER w AS image_n, row_number() OVER (PARTITION BY video_id, ts, head ORDER BY seq) - 1 AS dup FROM heads WINDOW w AS (PARTITION BY video_id ORDER BY seq)),
based AS (SELECT *, CASE WHEN head THEN CASE WHEN ts IS NOT NULL THEN 'mail_' || ts || CASE WHEN dup > 0 THEN '_' || (dup + 1) ELSE '' END ELSE printf('mail_unknown_%02d', mail_n::BIGINT) END END AS base FROM counted),
named AS (SELECT *, CASE WHEN kind = 'image' THEN printf('image_%03d.png', image_n::BIGINT) WHEN part_index IS NOT NULL THEN last_value(base IGNORE NULLS) OVER (PARTITION BY video_id, kind, seg, part_index IS NULL ORDER BY seq) || '_p' || part_index || 'of' || part_total || '.png' ELSE base || '.png' END AS name FROM based)"""


@query(f"WITH {_NAMED} SELECT key, video_id, seq::BIGINT AS seq, name FROM named")
def f8_w4_j6_names(spark, sf_dir):
    return naming.assign_names(B.outputs(spark, sf_dir)).select("key", "video_id", *_long("seq"), "name")


@query(f"WITH {B.OUTPUTS} SELECT key, seq::BIGINT AS seq FROM outputs WHERE included")
def p15_included(spark, sf_dir):
    return B.outputs(spark, sf_dir).where("included").select("key", *_long("seq"))


@query(f"WITH {B.OUTPUTS} SELECT video_id, count_if(kind = 'mail')::BIGINT AS mails, count_if(kind = 'image')::BIGINT AS images, count_if(included)::BIGINT AS included FROM outputs GROUP BY ALL")
def a9_output_counts(spark, sf_dir):
    o = B.outputs(spark, sf_dir)
    return o.groupBy("video_id").agg(F.count_if(F.col("kind") == "mail").alias("mails"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if("included").alias("included"))


@query(f"WITH {B.OUTPUTS}, meta AS (SELECT video_id, seg, min(idx)::BIGINT AS idx_start FROM (SELECT user_id AS video_id, (event_id % 9)::INT AS seg, event_id AS idx FROM events) GROUP BY ALL) SELECT key, idx_start FROM outputs LEFT JOIN meta USING (video_id, seg)")
def j3_with_metadata(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video_id"), (F.col("event_id") % 9).cast("int").alias("seg")).agg(F.min("event_id").alias("idx_start"))
    return naming.with_metadata(B.outputs(spark, sf_dir), e).select("key", "idx_start")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN printf('mail_%02d_seg%d_t%s', event_id % 100, event_id % 12, printf('%.3f', (event_id % 600) / 8e0))
  || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 4 = 0 THEN printf('_p%dof%d', event_id % 4 + 1, 4) ELSE '_stitched' END || '.png' ELSE printf('image_%03d.png', event_id % 100) END AS name FROM events""")
def f9_provisional_names(spark, sf_dir):
    k = F.col("event_id")
    n = naming.provisional_name(F.when(k % 2 == 0, "mail").otherwise("image"), k % 100, k % 12, k % 600 / 8, k % 3 > 0, k % 4 + 1, F.when(k % 4 == 0, 4).otherwise(1))
    return B.table(spark, sf_dir, "events").select("event_id", n.alias("name"))


@query(f"""WITH {_NAMED} SELECT video_id, '[' || string_agg('{{"file":"' || name || '","kind":"' || kind || '","timestamp":' || coalesce('"' || ts || '"', 'null') || ',"sender":null,"source_video":"v' || video_id || '.mp4","frame_range":[' || seq || ',' || (seq + 5) || '],"time_range_sec":[' || seq || '.5,' || (seq + 1) || '.5],"representative_frame":' || (seq + 2) || ',"stitched":' || (part_index IS NOT NULL) || '}}', ',' ORDER BY seq) || ']' AS metadata FROM named GROUP BY ALL""")
def s12_f11_metadata(spark, sf_dir):
    n = naming.assign_names(B.outputs(spark, sf_dir)).withColumns({
        "sender": F.lit(None).cast("string"), "source_video": F.concat(F.lit("v"), F.col("video_id").cast("string"), F.lit(".mp4")), "idx_start": F.col("seq"), "idx_end": F.col("seq") + 5,
        "t_start": F.col("seq") + 0.5, "t_end": F.col("seq") + 1.5, "idx": F.col("seq") + 2, "stitched": F.col("part_index").isNotNull(),
    })
    return naming.metadata(n.withColumns({"t_start": F.col("t_start").cast("double"), "t_end": F.col("t_end").cast("double")}))


# --- the store ------------------------------------------------------------------------


@query(f"WITH {B.JOBS} SELECT id, updated_at, created_at FROM jobs ORDER BY updated_at DESC, created_at DESC, id")
def s13_o2_jobs(spark, sf_dir):
    """The whole list; a range-partitioned sort."""
    return store.listed(B.jobs(spark, sf_dir)).select("id", "updated_at", "created_at")


@query("SELECT user_id, event_type AS key, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def s14_upsert_log(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), "event_id", "value", "ts")
    return store.latest(e, ["user_id", "key"], ["ts", "event_id"]).select("user_id", "key", "event_id", "value")


@query(f"""WITH {B.JOBS}, p AS (SELECT CASE WHEN o_orderkey % 15 = 0 THEN 'new-' ELSE 'job-' END || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'done' END AS status, o_orderkey % 2 = 0 AS has_status, o_orderkey % 6 = 0 AS has_heartbeat FROM orders WHERE o_orderkey % 3 = 0),
f AS (SELECT 'new-' || o_orderkey AS id, 'running' AS status, 1 AS heartbeat_at, 2 AS updated_at FROM orders WHERE o_orderkey % 10 = 0),
j AS (SELECT id, status, heartbeat_at, updated_at FROM jobs UNION ALL SELECT id, status, heartbeat_at, updated_at FROM f WHERE id IN (SELECT id FROM p))
SELECT j.id, CASE WHEN p.has_status THEN p.status ELSE j.status END AS status, CASE WHEN p.has_heartbeat THEN 5 ELSE heartbeat_at END::BIGINT AS heartbeat_at, CASE WHEN p.id IS NOT NULL THEN 99 ELSE updated_at END::BIGINT AS updated_at FROM j LEFT JOIN p USING (id)""")
def s15_patch_jobs(spark, sf_dir):
    """Some patches are for jobs that are not there; some of those have a row to fall back on."""
    k, o, jobs = F.col("o_orderkey"), B.table(spark, sf_dir, "orders"), B.jobs(spark, sf_dir)
    new = F.concat(F.lit("new-"), k.cast("string"))
    p = o.where("o_orderkey % 3 = 0").select(
        F.when(k % 15 == 0, new).otherwise(F.concat(F.lit("job-"), k.cast("string"))).alias("id"), F.when(k % 4 != 0, "done").alias("status"), (k % 2 == 0).alias("has_status"),
        F.lit(5).cast("long").alias("heartbeat_at"), (k % 6 == 0).alias("has_heartbeat_at"),
    )
    own = {"id": new, "status": F.lit("running"), "heartbeat_at": F.lit(1), "updated_at": F.lit(2)}
    f = o.where("o_orderkey % 10 = 0").select(*[own.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in jobs.schema])
    return store.patch(jobs, p, "id", ["status", "heartbeat_at"], F.lit(99), f).select("id", "status", "heartbeat_at", F.col("updated_at").cast("long").alias("updated_at"))


@query(f"WITH {B.JOBS} SELECT id, CASE WHEN owner_id = 'tab-7' AND status = 'running' AND id LIKE '%1' THEN 123 ELSE heartbeat_at END::BIGINT AS heartbeat_at FROM jobs")
def s16_heartbeat(spark, sf_dir):
    j = B.jobs(spark, sf_dir)
    return store.heartbeat(j, F.when(F.col("id").endswith("1"), F.col("id")), F.lit("tab-7"), F.lit(123)).select("id", F.col("heartbeat_at").cast("long").alias("heartbeat_at"))


@query(f"""WITH {B.JOBS}, m AS (SELECT *, status = 'running' AND owner_id IS DISTINCT FROM 'tab-7' AND (heartbeat_at IS NULL OR heartbeat_at = 0 OR created_at + 600000 - heartbeat_at > 300000) AS marked FROM jobs)
SELECT id, CASE WHEN marked THEN 'interrupted' ELSE status END AS status, marked FROM m""")
def s17_interrupted(spark, sf_dir):
    return store.interrupted(B.jobs(spark, sf_dir), F.lit("tab-7"), F.col("created_at") + 600_000).select("id", "status", "marked")


@query(f"WITH {B.OUTPUTS} SELECT key, seq::BIGINT AS seq FROM outputs WHERE video_id = 7")
def s18_j5_o3_outputs_of_job(spark, sf_dir):
    return store.outputs_of(B.outputs(spark, sf_dir).withColumnRenamed("video_id", "job_id"), 7).select("key", *_long("seq"))


@query(f"""WITH {B.OUTPUTS}, e AS (SELECT o_orderkey::VARCHAR AS key, o_orderkey % 2 = 0 AS inc, CASE WHEN o_orderkey % 8 = 0 THEN '2026-05-05_0505' END AS t FROM orders WHERE o_orderkey % 4 = 0)
SELECT key, coalesce(inc, included) AS included, coalesce(t, edited_ts) AS edited_ts FROM outputs LEFT JOIN e USING (key)""")
def s19_edit_outputs(spark, sf_dir):
    k = F.col("o_orderkey")
    e = B.table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(k.cast("string").alias("key"), (k % 2 == 0).alias("included"), F.when(k % 8 == 0, "2026-05-05_0505").alias("edited_ts"))
    return store.edit_outputs(B.outputs(spark, sf_dir), e).select("key", "included", "edited_ts")


@query(f"WITH {B.OUTPUTS} SELECT count(*) FILTER (false)::BIGINT AS outputs FROM outputs")
def s20_clear(spark, sf_dir):
    return store.cleared(B.outputs(spark, sf_dir)).agg(F.count("*").alias("outputs"))


@query(f"WITH {B.OUTPUTS} SELECT key, video_id FROM outputs WHERE video_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def s20_delete_jobs(spark, sf_dir):
    gone = B.table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("video_id"))
    return store.without(B.outputs(spark, sf_dir), gone, "video_id").select("key", "video_id")


@query("SELECT o_orderkey, 'v' || o_orderkey || '.mp4|' || (o_custkey * 1024) || '|' || epoch_ms(o_orderdate) AS fingerprint FROM orders")
def s22_fingerprint(spark, sf_dir):
    k = F.col("o_orderkey")
    return B.table(spark, sf_dir, "orders").select("o_orderkey", X.fingerprint(F.concat(F.lit("v"), k.cast("string"), F.lit(".mp4")), F.col("o_custkey") * 1024, (X.micros(F.col("o_orderdate")) / 1000).cast("long")).alias("fingerprint"))


@query("""WITH u AS (SELECT user_id AS video_id, event_id % 4 AS seg, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_id % 3 = 0 THEN event_type END AS t, CASE WHEN event_id % 5 = 0 THEN 's' || event_id END AS s FROM events),
l AS (SELECT video_id, seg, last(t ORDER BY n) FILTER (t IS NOT NULL) AS t, last(s ORDER BY n) FILTER (s IS NOT NULL) AS s FROM u GROUP BY ALL)
SELECT video_id, string_agg(seg || '=' || coalesce(t, '-') || '/' || coalesce(s, '-'), ',' ORDER BY seg) AS meta FROM l GROUP BY ALL""")
def f13_merged_meta(spark, sf_dir):
    k = F.col("event_id")
    u = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), (k % 4).cast("int").alias("seg"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"), F.when(k % 3 == 0, F.col("event_type")).alias("timestamp"), F.when(k % 5 == 0, F.concat(F.lit("s"), k.cast("string"))).alias("sender"))
    e = F.transform(F.map_entries("seg_meta"), lambda x: F.concat(x["key"].cast("string"), F.lit("="), F.coalesce(x["value"]["timestamp"], F.lit("-")), F.lit("/"), F.coalesce(x["value"]["sender"], F.lit("-"))))
    return store.merged_meta(u).select("video_id", F.concat_ws(",", e).alias("meta"))


@query("WITH m AS (SELECT event_id, 'job-' || (user_id % 3) AS msg, CASE WHEN event_id % 4 > 1 THEN 'job-' || (event_id % 3) WHEN event_id % 4 = 1 THEN '' END AS active FROM events) SELECT event_id, coalesce(active <> '' AND msg = active, false) AS accepted FROM m")
def p14_accepts_message(spark, sf_dir):
    k = F.col("event_id")
    active = F.when(k % 4 > 1, F.concat(F.lit("job-"), (k % 3).cast("string"))).when(k % 4 == 1, "")
    return B.table(spark, sf_dir, "events").select("event_id", X.accepts_message(F.concat(F.lit("job-"), (F.col("user_id") % 3).cast("string")), active).alias("accepted"))


@query("""SELECT event_id, (event_id % 1800) / 6e0 AS t, CASE WHEN value / 300 > 0.02e0 THEN event_id % 100 / (value / 300) * (1e0 - value / 300) END AS eta,
  CASE WHEN event_id % 3 > 0 AND event_id % 1000 * 1000 > 600000 THEN 'abort' WHEN event_id % 3 > 0 AND event_id % 1000 * 1000 > 180000 THEN 'warn' END AS stalled FROM events""")
def p16_p17_time_and_eta(spark, sf_dir):
    k = F.col("event_id")
    return B.table(spark, sf_dir, "events").select("event_id", X.seconds(k % 1800).alias("t"), X.eta(k % 100, F.col("value") / 300).alias("eta"), X.stall(k % 3 > 0, k % 1000 * 1000).alias("stalled"))


@query(f"WITH {B.STABLE} SELECT video_id, count(*)::BIGINT AS frames, count_if(cat = 'detail')::BIGINT AS details, count_if(stable)::BIGINT AS stable, max(idx)::BIGINT AS last_frame FROM stable GROUP BY ALL")
def a5_counters(spark, sf_dir):
    s = select.stability(fr.segments(B.frames(spark, sf_dir)))
    return s.groupBy("video_id").agg(F.count("*").alias("frames"), F.count_if(F.col("cat") == "detail").alias("details"), F.count_if("stable").alias("stable"), F.max("idx").cast("long").alias("last_frame"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
