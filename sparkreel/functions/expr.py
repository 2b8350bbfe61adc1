"""Scalar functions as Column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


# --- pixels and geometry -------------------------------------------------------------

def gray_pillow(r: Column, g: Column, b: Column) -> Column:
    """8-bit luma with 16-bit weights."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def gray_cv(r: Column, g: Column, b: Column) -> Column:
    """8-bit luma with 14-bit weights, as the correlation uses it."""
    return F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14)


def band_edge(size: Column, part: float) -> Column:
    """Pixel at a relative position; the product is taken in double."""
    return (size.cast("double") * F.lit(float(part))).cast("int")


def band(pixels: Column, width: Column, height: Column, part: tuple[float, float]) -> Column:
    """Pixels of a row-major array between two relative heights."""
    top, bottom = band_edge(height, part[0]), band_edge(height, part[1])
    return F.slice(pixels, top * width + 1, (bottom - top) * width)


def count_below(pixels: Column, limit: int) -> Column:
    return F.size(F.filter(pixels, lambda p: p < limit))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def body_metric(pixels: Column, width: Column, height: Column) -> Column:
    """Share of non-white pixels in the body band."""
    b = band(pixels, width, height, K.BODY_Y)
    return ratio(count_below(b, K.NON_WHITE_PX), F.size(b))


def darkness(pixels: Column, width: Column, height: Column) -> Column:
    """Share of dark pixels in the top and bottom bands, over one common denominator."""
    top, bottom = band(pixels, width, height, K.DARK_TOP_Y), band(pixels, width, height, K.DARK_BOTTOM_Y)
    return ratio(count_below(top, K.DARK_PX) + count_below(bottom, K.DARK_PX), F.size(top) + F.size(bottom))


def is_saturated(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return (high - low) * K.SATURATION_SCALE > high


# --- classification ------------------------------------------------------------------

def categorize(bm: Column, dk: Column) -> Column:
    """The order of the branches matters; all comparisons are strict."""
    return F.when(dk > K.FULLSCREEN_DK, "fullscreen_image").when(bm < K.LOADING_BM, "loading").when(bm < K.LIST_BM, "list").otherwise("detail")


def is_boundary(cat: Column, hd: Column) -> Column:
    return (cat == "loading") & (hd > K.HEADER_HD)


def seconds(idx: Column) -> Column:
    return idx.cast("double") / F.lit(float(K.FPS))


def slot_of(ts_us: Column, t0_us: Column, fps: float = K.FPS) -> Column:
    """Slot of a time stamp: rounded half up, with a small allowance for rounded input."""
    return F.floor((ts_us - t0_us).cast("double") * F.lit(float(fps)) / F.lit(1e6) + F.lit(0.5) + F.lit(K.ROUND_EPS)).cast("long")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time stamp without zone, whatever the session's zone is."""
    clock = F.hour(ts).cast("long") * 3600 + F.minute(ts) * 60
    return (F.unix_date(ts.cast("date")).cast("long") * 86_400 + clock) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def chunk_slot(start_s: Column, fps: Column, i: Column) -> Column:
    """Slot of frame i of a chunk that starts at start_s seconds."""
    return F.floor(start_s * fps + 0.5).cast("long") + i


def eta(elapsed: Column, progress: Column) -> Column:
    """Remaining time, null while there is too little progress to tell."""
    return F.when(progress > K.ETA_FROM, elapsed / progress * (F.lit(1.0) - progress))


def stall(running: Column, silent_ms: Column) -> Column:
    """What a running job's silence means: null, warn or abort."""
    return F.when(running & (silent_ms > K.STALL_ABORT_MS), "abort").when(running & (silent_ms > K.STALL_WARN_MS), "warn")


# --- hashes --------------------------------------------------------------------------

def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_to_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def hash_from_hex(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


# --- stitching -----------------------------------------------------------------------

def round_half_even(x: Column) -> Column:
    return F.rint(x).cast("int")


def added_rows(dy: Column, height: Column, skip: Column) -> Column:
    return F.least(round_half_even(dy), height - skip)


def max_rows(width: Column, budget: int = K.MAX_STITCH_BYTES) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / (width * 4)).cast("long"))


def optimal_dft_size(n: Column, limit: int = 1 << 16) -> Column:
    """Smallest 2^a 3^b 5^c that is n or more."""
    sizes = sorted(2**a * 3**b * 5**c for a in range(18) for b in range(12) for c in range(8) if 2**a * 3**b * 5**c <= limit)
    return F.element_at(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= n), 1)


# --- text ----------------------------------------------------------------------------

def valid_date_time(y: Column, mo: Column, d: Column, h: Column, mi: Column) -> Column:
    """Whether the five numbers are a moment of the calendar."""
    clock = h.between(0, 23) & mi.between(0, 59)
    return F.coalesce(clock & F.try_make_timestamp_ntz(y, mo, d, F.lit(0), F.lit(0), F.lit(0)).isNotNull(), F.lit(False))


def _numbers(text: Column, pattern: str) -> list[Column]:
    return [F.regexp_extract(text, pattern, k) for k in range(1, 6)]


def parse_timestamp(text: Column) -> Column:
    """YYYY-MM-DD_HHMM of the first match, or null if there is none or it is no date."""
    parts = _numbers(text, K.TIMESTAMP)
    ok = (parts[0] != "") & valid_date_time(*[p.try_cast("int") for p in parts])
    return F.when(ok, F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2], F.lit("_"), parts[3], parts[4]))


def format_timestamp(ts: Column) -> Column:
    return F.regexp_replace(ts, K.STORED_TIMESTAMP, "$1 $2:$3")


def normalize_timestamp(text: Column) -> Column:
    """YYYY-MM-DD_HHMM of what a person typed, or null."""
    parts = _numbers(text, K.TYPED_TIMESTAMP)
    n = [p.try_cast("int") for p in parts]
    ok = (parts[0] != "") & valid_date_time(*n)
    return F.when(ok, F.format_string("%s-%02d-%02d_%02d%02d", parts[0], *n[1:]))


def clean_sender(text: Column) -> Column:
    """The words of a text on one line without noise marks, Japanese words unspaced; null if nothing is left."""
    words = F.filter(F.split(F.translate(text, K.NOISE_MARKS, ""), K.BLANKS), lambda w: w != "")
    glued = F.regexp_replace(F.array_join(words, " "), f"(?<={K.JAPANESE}) (?={K.JAPANESE})", "")
    return F.nullif(glued, F.lit(""))


def mail_file(ts: Column, ordinal: Column, dup: Column) -> Column:
    base = F.when(ts.isNotNull(), F.concat(F.lit(K.MAIL_NAME), ts)).otherwise(F.format_string(K.UNKNOWN_MAIL, ordinal))
    return F.concat(base, F.when(dup > 0, F.concat(F.lit("_"), (dup + 1).cast("string"))).otherwise(F.lit("")), F.lit(".png"))


def image_file(ordinal: Column) -> Column:
    return F.format_string(K.IMAGE_NAME, ordinal)


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, K.EXTENSION, "")


def accepts_file(name: Column, mime: Column) -> Column:
    """Video files, by extension or media type."""
    return name.rlike(K.VIDEO_FILE) | F.coalesce(mime.startswith("video/"), F.lit(False))


def accepts_message(message_job: Column, active_job: Column) -> Column:
    """Whether a message belongs to the active job; no active job accepts none."""
    return F.coalesce((active_job != "") & (message_job == active_job), F.lit(False))


def fingerprint(name: Column, size: Column, modified: Column) -> Column:
    return F.concat_ws("|", name, size.cast("string"), modified.cast("string"))
