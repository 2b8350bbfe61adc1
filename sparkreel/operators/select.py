"""Representatives of segments and removal of repeats by perceptual hash."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expr as X
from .cluster import cut, small_side


def stability(segmented: DataFrame, distance: int = K.STABLE_DISTANCE) -> DataFrame:
    """stable: near the frame of the same category before it in the segment. The first never is."""
    order = W.partitionBy("video_id", "seg", "cat").orderBy("idx")
    return segmented.withColumn("stable", F.coalesce(X.hamming(F.col("h"), F.lag("h").over(order)) <= distance, F.lit(False)))


def representatives(stable: DataFrame) -> DataFrame:
    """The detail frame of each segment: stable ones first, then the fullest body, then the earliest."""
    best = W.partitionBy("video_id", "seg").orderBy(F.desc("stable"), F.desc("bm"), "idx")
    return stable.where("cat = 'detail'").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def candidates(stable: DataFrame) -> DataFrame:
    """Mails and images in the order in which they are judged: (video_id, seg, kind, idx, bm, h, from_stable)."""
    mails = representatives(stable).select("video_id", "seg", F.lit("mail").alias("kind"), F.lit(0).alias("ord"), "idx", "bm", "h", F.col("stable").alias("from_stable"))
    images = stable.where("cat = 'fullscreen_image' and stable").select("video_id", "seg", F.lit("image").alias("kind"), F.lit(1).alias("ord"), "idx", "bm", "h", F.col("stable").alias("from_stable"))
    return mails.unionByName(images)


#: Different hashes of a key that one task judges in order; neighbours of a key that one task folds.
FOLD_HASHES, FOLD_EDGES = 20_000, 1_000_000


def greedy(items: DataFrame, keys: list[str], order: list[str], h: str = "h", distance: int = K.DUP_DISTANCE, most: int = FOLD_HASHES, edges: int = FOLD_EDGES) -> DataFrame:
    """Items in order, with `kept`: no kept item before is within `distance` bits.

    The kept items are the lexicographically first maximal independent set of the near graph. Of
    equal hashes of a key only the first matters: if it goes, what it is too near to stands before
    all of them. So keys are judged by their different hashes. Keys with up to `most` of them are
    one small fold each; larger ones are judged in rounds over all tasks (_rounds). Items without a
    hash are near nothing. Rows that share a place and a hash are judged as one.
    """
    if not keys:
        return greedy(items.withColumn("_all", F.lit(0)), ["_all"], order, h, distance, most, edges).drop("_all")
    place = F.struct(*[F.col(f"`{f}`").alias(f) for f in order])
    narrow = items.select(*keys, place.alias("_at"), F.col(h).cast("long").alias("_h")).where("_h is not null")
    first = cut(narrow.groupBy(*keys, "_h").agg(F.min("_at").alias("_at")))
    large = cut(first.groupBy(*keys).count().where(F.col("count") > most).select(*keys))
    if large.isEmpty():
        kept = _folded(first, keys, distance)
    else:
        large = small_side(large)
        kept = _folded(_in(first, large, keys, "left_anti"), keys, distance)
        kept = kept.unionByName(_rounds(cut(_in(first, large, keys, "left_semi")), keys, distance, most, edges))
    kept = kept.withColumn("_kept", F.lit(True))
    marked = items.withColumn("_at", place).withColumn("_h", F.col(h).cast("long"))
    joined = _joined(marked, kept, [*keys, "_at", "_h"])
    return joined.withColumn("kept", F.col("_h").isNull() | F.col("_kept").isNotNull()).select(*[F.col(f"`{c}`") for c in items.columns], "kept")


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join in which null keys are equal to each other."""
    right = right.select(*[F.col(c).alias(f"_r{k}") for k, c in enumerate(on)], *[c for c in right.columns if c not in on])
    same = F.lit(True)
    for k, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_r{k}"))
    return left.join(right, same, how).drop(*[f"_r{k}" for k in range(len(on))])


def _in(rows: DataFrame, some: DataFrame, keys: list[str], how: str) -> DataFrame:
    return _joined(rows, some, keys, how)


def _folded(first: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """The kept of (*keys, _h, _at), key by key in one pass over its hashes."""

    def fold(group: pa.Table) -> pa.Table:
        places = [tuple((x is not None, x) for x in at.values()) for at in group["_at"].to_pylist()]
        hashes = np.asarray(group["_h"], np.int64).view(np.uint64)
        kept, n, out = np.zeros(len(places), np.uint64), 0, []
        for k in sorted(range(len(places)), key=lambda k: (places[k], int(hashes[k]))):
            if not n or int(np.bitwise_count(kept[:n] ^ hashes[k]).min()) > distance:
                kept[n] = hashes[k]
                n += 1
                out.append(k)
        return group.take(pa.array(out, pa.int64()))

    columns = [*keys, "_at", "_h"]
    first = first.select(*columns)
    return first.groupBy(*keys).applyInArrow(fold, first.schema)


def _cells(rows: DataFrame, keys: list[str], distance: int) -> tuple[DataFrame, list[str]]:
    """Each item once for each of distance + 1 bands of its hash: near items share the bits of a band at least."""
    bands = distance + 1
    width = 64 // bands
    bits = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("_h", k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("bits")) for k in range(bands)]
    return rows.select(*keys, "_at", "_h", F.explode(F.array(*bits)).alias("_c")).select(*keys, "_at", "_h", "_c.band", "_c.bits"), [*keys, "band", "bits"]


def _swept(rows: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """The undecided items with `_sure` (no undecided item before is near) and `_lost` (a sure one is), as far as the first item of each cell tells.

    An item that comes first in all its cells has no near item before it; and it comes first in each
    cell that it shares with a near item, so comparing items with the first of their cells finds
    all that it removes. Rows are items times bands, however near they are.
    """
    cells, by = _cells(rows, keys, distance)
    head = F.min(F.struct("_at", "_h")).over(W.partitionBy(*by))
    seen = cells.withColumn("_f", head).withColumn("_own", (F.col("_f._at") == F.col("_at")) & (F.col("_f._h") == F.col("_h")))
    near = ~F.col("_own") & (X.hamming(F.col("_h"), F.col("_f._h")) <= distance)
    told = seen.groupBy(*keys, "_at", "_h").agg(F.min("_own").alias("_sure"), F.collect_set(F.when(near, F.col("_f"))).alias("_by"))
    told = cut(told)
    sure = told.where("_sure").select(*keys, F.struct("_at", "_h").alias("_f"), F.lit(True).alias("_hit"))
    asked = told.where("size(_by) > 0").select(*keys, "_at", "_h", F.explode("_by").alias("_f"))
    lost = _joined(asked, sure, [*keys, "_f"], "left_semi").select(*keys, "_at", "_h").distinct().withColumn("_lost", F.lit(True))
    return _joined(told.drop("_by"), lost, [*keys, "_at", "_h"]).withColumn("_lost", F.col("_lost").isNotNull())


def _rounds(rows: DataFrame, keys: list[str], distance: int, most: int, edges: int) -> DataFrame:
    """The kept of (*keys, _h, _at), a round over all keys at a time.

    First sweeps by cells, as long as one decides a tenth of what is left. Keys with up to `most`
    items left are folded. Of the others the near pairs are made, and in each round the items
    without an undecided neighbour before them stay and their neighbours go; keys with up to `edges`
    pairs left are folded by their pairs.
    """
    columns = [*keys, "_at", "_h"]
    kept, left = [], rows.count()
    while left:
        swept = cut(_swept(rows, keys, distance))
        kept.append(swept.where("_sure").select(*columns))
        rows = swept.where("not _sure and not _lost").select(*columns)
        counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        few = small_side(counts.where(F.col("_n") <= most).select(*keys))
        kept.append(_folded(_in(rows, few, keys, "left_semi"), keys, distance))
        rows = cut(_in(rows, few, keys, "left_anti"))
        before, left = left, rows.count()
        if left > 0.9 * before:
            break
    if left:
        pairs = cut(near_pairs(rows.select(*keys, F.struct("_at", "_h").alias("_x"), "_h"), keys, "_x", "_h", distance, min(distance + 1, 8)).drop("distance"))
        node = lambda end: F.col(end).alias("_x")
        lost = []
        while True:
            sizes = pairs.groupBy(*keys).count()
            over = small_side(sizes.where(F.col("count") > edges).select(*keys))
            lost.append(_lost_by_pairs(_in(pairs, over, keys, "left_anti"), keys))
            pairs = _in(pairs, over, keys, "left_semi")
            if over.isEmpty():
                break
            pairs = cut(pairs)
            waits = pairs.select(*keys, node("b")).distinct()
            gone = cut(_joined(pairs.withColumn("_x", F.col("a")), waits, [*keys, "_x"], "left_anti").select(*keys, node("b")).distinct())
            lost.append(gone)
            for end in ("a", "b"):
                pairs = _joined(pairs.withColumn("_x", F.col(end)), gone, [*keys, "_x"], "left_anti").drop("_x")
            pairs = cut(pairs)
        everything = lost[0]
        for part in lost[1:]:
            everything = everything.unionByName(part)
        kept.append(_joined(rows.withColumn("_x", F.struct("_at", "_h")), everything, [*keys, "_x"], "left_anti").select(*columns))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def _lost_by_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, _x) of the items that a kept one precedes, by one fold over each key's pairs."""

    def order(x: dict) -> tuple:
        return (*((v is not None, v) for v in x["_at"].values()), x["_h"])

    def fold(group: pa.Table) -> pa.Table:
        before: dict[tuple, list] = {}
        row_of = {}
        for k, (a, b) in enumerate(zip(group["a"].to_pylist(), group["b"].to_pylist(), strict=True)):
            before.setdefault(order(b), []).append(order(a))
            row_of[order(b)] = k
        gone = set()
        for b in sorted(before):
            if any(a not in gone for a in before[b]):
                gone.add(b)
        rows = group.take(pa.array([row_of[b] for b in gone], pa.int64()))
        return rows.drop_columns(["a"]).rename_columns([*keys, "_x"])

    shaped = pairs.select(*keys, "a", "b")
    out = shaped.select(*keys, F.col("b").alias("_x")).schema
    return shaped.groupBy(*keys).applyInArrow(fold, out)


def near_pairs(items: DataFrame, keys: list[str], place: str, h: str, distance: int, bands: int = 4) -> DataFrame:
    """Pairs a < b (by place) of a key within `distance` bits: (*keys, a, b, distance).

    64 bits are cut into bands; of a pair one band differs in at most distance // bands bits. So b
    stands in each band under its bits, and a is sent there under its bits with every choice of
    that few flipped. Few wide bands have few chance hits, which suits large keys; distance + 1
    bands need no flips, which suits many small ones.
    """
    width, flips = 64 // bands, distance // bands
    masks = [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(width), k)]
    bits = lambda k: F.shiftrightunsigned(h, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    cell = lambda k, mask: F.struct(F.lit(k).alias("band"), bits(k).bitwiseXOR(F.lit(mask).cast("long")).alias("bits"))
    own = F.array(*[cell(k, 0) for k in range(bands)])
    probes = F.array(*[cell(k, m) for k in range(bands) for m in masks])
    rows = lambda cells, at, hash_: items.select(*keys, F.col(place).alias(at), F.col(h).alias(hash_), F.explode(cells).alias("_c")).select(*keys, at, hash_, "_c.band", "_c.bits")
    pairs = rows(probes, "a", "_ha").join(rows(own, "b", "_hb"), [*keys, "band", "bits"]).where("a < b")
    gap = X.hamming(F.col("_ha"), F.col("_hb"))
    return pairs.where(gap <= distance).select(*keys, "a", "b", gap.alias("distance")).distinct()


def candidate_edges(items: DataFrame, id_: str, h: str, distance: int) -> DataFrame:
    """Pairs (a < b) within `distance` bits of a table, by near_pairs."""
    return near_pairs(items.select(F.col(id_).alias("_at"), F.col(h).alias("_h")), [], "_at", "_h", distance)


def pending(images: DataFrame, distance: int = K.DUP_DISTANCE, limit: int = K.MAX_PENDING) -> DataFrame:
    """Stable images of each segment after removal of repeats inside it, with overflow beyond `limit`."""
    kept = greedy(images, ["video_id", "seg"], ["idx"], "h", distance).where("kept")
    n = F.row_number().over(W.partitionBy("video_id", "seg").orderBy("idx"))
    return kept.withColumn("overflow", n > limit).drop("kept")


def select_events(stable: DataFrame, distance: int = K.DUP_DISTANCE) -> DataFrame:
    """All mails and images with event selected or skipped; mail before images, one memory per video."""
    judged = greedy(candidates(stable), ["video_id"], ["seg", "ord", "idx"], "h", distance)
    event = F.when(F.col("kept"), "selected").otherwise("skipped")
    return judged.select("video_id", "seg", "kind", "idx", "bm", "h", "from_stable", event.alias("event"), F.when(~F.col("kept"), "duplicate").alias("reason"))


class HashIndex:
    """Hashes by the bits of 4 bands of 16: whether one within `distance` bits is held.

    Near hashes differ in one band by at most distance // 4 bits, so a look asks for the cells with
    that few bits flipped: a fixed number, however many hashes are held. `cells` maps (band, bits) to a
    list of hashes; a state store's map will do.
    """

    WIDTH = 16

    def __init__(self, distance: int, cells=None):
        self.distance, self.cells = distance, {} if cells is None else cells
        flips = distance * self.WIDTH // 64
        self.masks = [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(self.WIDTH), k)]

    def _bits(self, h: int) -> list[tuple[int, int]]:
        return [(band, h >> band * self.WIDTH & (1 << self.WIDTH) - 1) for band in range(64 // self.WIDTH)]

    def near(self, h: int) -> bool:
        for band, bits in self._bits(h):
            for mask in self.masks:
                if any(((h ^ x) & (1 << 64) - 1).bit_count() <= self.distance for x in self.cells.get((band, bits ^ mask), ())):
                    return True
        return False

    def add(self, h: int) -> None:
        for cell in self._bits(h):
            self.cells[cell] = [*self.cells.get(cell, ()), h]


class OpenSegment:
    """The streaming rule for one segment: an image is held if it is near nothing seen or held, up to
    `limit`; at the end the mail is judged, then the held images. `seen` is what was selected before,
    and grows. Items without a hash are near nothing."""

    def __init__(self, seg: int, distance: int, limit: int, seen: HashIndex):
        self.seg, self.distance, self.limit, self.seen, self.held = seg, distance, limit, seen, []

    def _event(self, kind: str, x: dict, from_stable: bool, event: str, reason: str | None) -> tuple:
        return (self.seg, kind, x["idx"], x["bm"], x["h"], from_stable, event, reason)

    def image(self, x: dict) -> list[tuple]:
        """The event of an image that is decided at once: one beyond the limit."""
        h = x["h"]
        if h is not None and (self.seen.near(h) or any(y["h"] is not None and ((h ^ y["h"]) & (1 << 64) - 1).bit_count() <= self.distance for y in self.held)):
            return []
        if len(self.held) < self.limit:
            self.held.append(x)
            return []
        return [self._event("image", x, True, "skipped", "pending_overflow")]

    def close(self, mail: dict | None) -> list[tuple]:
        out = []
        for kind, x in [("mail", mail)] * (mail is not None) + [("image", x) for x in self.held]:
            dup = x["h"] is not None and self.seen.near(x["h"])
            if not dup and x["h"] is not None:
                self.seen.add(x["h"])
            out.append(self._event(kind, x, x["from_stable"], "skipped" if dup else "selected", "duplicate" if dup else None))
        return out


def close_segments(segs: list[dict], distance: int, limit: int, seen: HashIndex | None = None) -> list[tuple]:
    """Events of one video under the streaming rule, segment by segment (OpenSegment)."""
    seen = HashIndex(distance) if seen is None else seen
    out = []
    for s in segs:
        segment = OpenSegment(s["seg"], distance, limit, seen)
        over = [e for x in s["images"] for e in segment.image(x)]
        out += segment.close(s["mail"]) + over
    return out


#: Events of select_events_held, and how many of them a task gathers before it hands them over.
HELD, HELD_ROWS = "video_id long, seg int, kind string, idx int, bm double, h long, from_stable boolean, event string, reason string", 10_000


def select_events_held(stable: DataFrame, distance: int = K.DUP_DISTANCE, limit: int = K.MAX_PENDING) -> DataFrame:
    """select_events under the streaming rule (held images, overflow).

    The candidates pass through tasks in order, many videos to a task: a group per video would cost
    far more than judging the few candidates in it. A task holds one segment's mail and held images
    and what the video selected before, however long segments and videos are.
    """
    columns = ["video_id", "seg", "ord", "idx", "bm", "h", "from_stable"]
    rows = candidates(stable).selectExpr("cast(video_id as long) video_id", "cast(seg as int) seg", "ord", "cast(idx as int) idx", "cast(bm as double) bm", "cast(h as long) h", "from_stable")
    rows = rows.repartition("video_id").sortWithinPartitions("video_id", "seg", "ord", "idx")
    schema = pa.schema([("video_id", pa.int64()), ("seg", pa.int32()), ("kind", pa.string()), ("idx", pa.int32()), ("bm", pa.float64()), ("h", pa.int64()), ("from_stable", pa.bool_()), ("event", pa.string()), ("reason", pa.string())])

    def judge(batches):
        out, at, seen, segment, mail = [], None, None, None, None

        def handed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for video, seg, ord_, idx, bm, h, from_stable in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if at != (video, seg):
                    if segment is not None:
                        out += [(at[0], *e) for e in segment.close(mail)]
                    if segment is None or at[0] != video:
                        seen = HashIndex(distance)
                    at, segment, mail = (video, seg), OpenSegment(seg, distance, limit, seen), None
                x = {"idx": idx, "bm": bm, "h": h, "from_stable": from_stable}
                if ord_ == 0:
                    mail = x
                else:
                    out += [(video, *e) for e in segment.image(x)]
                if len(out) >= HELD_ROWS:
                    yield handed()
        if segment is not None:
            out += [(at[0], *e) for e in segment.close(mail)]
        if out:
            yield handed()

    return rows.mapInArrow(judge, HELD)
