"""Quality rules whose threshold carries a guarantee on false rejections.

Base counts per document come from the whole text. A base failure (too few words, or
too much repetition) rejects at once. Five further rules (RULES) score a document, each
as a share of a fixed scale. They form one family along a single path: at step s of it
every rule rejects what reaches s / GRID of its scale, so a document's place is its
largest share. Where a stratum (language) stops on that path is not chosen by hand.
Labelled good documents that pass the base are the holdout, and the steps are tested
from the most lenient on. A step stands if the exact binomial (Clopper-Pearson) upper
bound of the share of good documents it rejects is at most ALPHA, at confidence
1 - DELTA / tested strata (Bonferroni); testing stops at the first that fails (fixed-sequence
testing, so the path itself costs no correction). With probability 1 - DELTA, no stratum
loses more than ALPHA of its good documents to these rules. The path is fixed
beforehand, so no label is used twice.

Every stratum is judged by its own labels. A step can stand at all only with n good labels such that
(1 - ALPHA)^n <= DELTA / strata; a stratum with fewer can reject nothing, so it is not tested and
takes no part of DELTA. Which ones are tested follows from the numbers of labels alone, never from scores: the
m strata with most labels, m as large as all of them have enough for m. In the others, and in
languages without labels, everything that passes the base is kept. With too few labels in every stratum
(148 at the default parameters) that is so everywhere.

Scale. One pass over texts makes one narrow row per document, which is written to the
shared folder once; labels join those rows by doc_id. Strata are tested in tasks, each from its GRID counts, and
their cutoffs join the rows, broadcast if they are few. No number of strata is special.

Defined cases: null or empty text has no words and fails the base. A null language is a
stratum of its own. A doc_id labelled several times counts as good if any label is good;
null labels and null ids count for nothing. Repeated rows are judged alike. Other
columns, whatever their names, are ignored. Empty tables give no rows; without labels,
every document that passes the base is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.cluster import small_side
from . import blocks as bl
from . import textkit as tk

ALPHA, DELTA = 0.02, 0.05
GRID = 100
MIN_WORDS = 50

_COUNTS = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Score of each rule as a share of its scale (1: as bad as it gets); texts without words score 0. Scales are
#: a symbol for each word, half of the words repeated, all lines repeated, 20 characters a word, words of 0.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "repeats": "2D * n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "long_words": "word_chars / greatest(n_words, 1) / 20D",
    "short_words": "1D - word_chars / greatest(n_words, 1) / 4D",
}
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"[#*$%&|<>]"[1:-1], np.uint8))


def dup_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those of them that equal an earlier one)."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row."""
    starts, ends, first = tk.words(buf, off)
    n = np.diff(first)

    def per_row(mask):
        total = np.append(0, np.cumsum(mask))
        return total[off[1:]] - total[off[:-1]]

    out = {"n_words": n, "word_chars": per_row(~tk.is_space(buf) & ((buf & 0xC0) != 0x80)), "n_symbols": per_row(_SYMBOL[buf])}
    h = tk.window_hashes(tk.span_hashes(buf, starts, ends), 3)
    at, row = tk.expand(first[:-1], np.maximum(n - 2, 0))
    key = tk.mix(h[at] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.append(False, key[order[1:]] == key[order[:-1]]) if len(key) else np.zeros(0, bool)
    same[:-1] |= same[1:]
    twice = at[order[same]]
    hit = np.append(0, np.cumsum(tk.cover(twice, twice + 3, len(starts))))
    out["n_repeat_words"] = hit[first[1:]] - hit[first[:-1]]
    raw = buf.tobytes()
    lines = np.array([dup_lines(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], np.int64).reshape(-1, 2)
    return out | {"n_lines": lines[:, 0], "n_dup_lines": lines[:, 1]}


_SCHEMA = pa.schema([(x.split()[0], pa.string() if "string" in x else pa.int64()) for x in _COUNTS.split(", ")])


def _measure(stream):
    for rb in stream:
        for a, b, buf, off in tk.text_slices(rb, "text", 1 << 20):
            got = counts(buf, off)
            cols = [rb.column(0).slice(a, b - a), rb.column(1).slice(a, b - a)] + [pa.array(got[f.name].astype(np.int64)) for f in list(_SCHEMA)[2:]]
            yield pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)


def at_most(k: int, n: int, p: float) -> float:
    """Probability of k or fewer of n, each with probability p; by logarithms, so that large n do not underflow."""
    i = np.arange(1, k + 1)
    steps = np.log(n - i + 1) - np.log(i) + math.log(p) - math.log1p(-p)
    return float(np.exp(n * math.log1p(-p) + np.append(0, np.cumsum(steps))).sum())


def upper_bound(k: int, n: int, delta: float) -> float:
    """Largest rate at which k or fewer of n still have probability delta (Clopper-Pearson); 1 without any."""
    if k >= n:
        return 1.0
    lo, hi = 1e-12, 1.0 - 1e-12
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at_most(k, n, mid) > delta else (lo, mid)
    return hi


def needed(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good labels without which no step of a stratum can stand."""
    return math.ceil(math.log(delta / strata) / math.log1p(-alpha))


def tested(strata: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Of (_s, n) the strata that are tested, with `_m`, how many they are; equal n by name."""
    enough = strata.where(F.col("n") >= needed(1, alpha, delta)).withColumn("_rank", F.row_number().over(W.orderBy(F.desc("n"), "_s")))
    stands = F.col("n") >= F.ceil(F.log(F.lit(delta) / F.col("_rank")) / math.log1p(-alpha))
    m = F.max(F.when(stands, F.col("_rank"))).over(W.partitionBy())
    return enough.withColumn("_m", m).where(F.col("_rank") <= F.col("_m")).select("_s", "_m")


def cutoff(by_step: list[int], strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """The lowest step that stands in one of `strata` tested strata (GRID: none, nothing is rejected).

    by_step[s]: good holdout documents whose place is step s (0 .. GRID - 1). A cutoff at
    step s rejects places in steps s and above.
    """
    n, gone, step = sum(by_step), 0, len(by_step)
    # the upper bound is at most alpha just if so few are improbable at alpha
    while step > 1 and (k := gone + by_step[step - 1]) < n and at_most(k, n, alpha) <= delta / strata:
        step -= 1
        gone += by_step[step]
    return step


def _cutoffs(alpha: float, delta: float):
    def run(group: pa.Table) -> pa.Table:
        by_step = [0] * GRID
        for place, n in zip(group["place"].to_pylist(), group["count"].to_pylist(), strict=True):
            by_step[place] += n
        return pa.table({"_cs": group["_s"].slice(0, 1), "_cut": pa.array([cutoff(by_step, group["_m"][0].as_py(), alpha, delta)], pa.int32())})

    return run


def measured(docs: DataFrame) -> DataFrame:
    """Counts, place (step on the path), the rule that sets it (the first of equal ones) and base_failed of each document."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) stratum", "cast(text as string) text").mapInArrow(_measure, _COUNTS)
    shares = [F.greatest(F.lit(0.0), F.expr(f"if(n_words = 0, 0D, {v})")) for v in RULES.values()]
    worst = F.greatest(*shares)
    rule = F.coalesce(*[F.when(x == worst, F.lit(k)) for k, x in zip(RULES, shares, strict=True)])
    place = F.floor(F.least(worst, F.lit(0.999999)) * GRID).cast("int")
    return rows.withColumns({"place": place, "rule": rule, "base_failed": F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")})


#: The name of the stratum without language, which no language has.
_NONE = "\0"


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): the base counts, base_failed, kept, and rejected_by: the rule that rejects, if one does."""
    rows = bl.cut(measured(docs)).withColumn("_s", F.coalesce("stratum", F.lit(_NONE)))
    good = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1")
    held = bl.cut(rows.where("not base_failed").join(good, "doc_id").groupBy("_s", "place").count())  # narrow: one row a language and step
    chosen = tested(held.groupBy("_s").agg(F.sum("count").alias("n")), alpha, delta)
    cuts = held.join(chosen, "_s").select("_s", "place", "count", "_m").groupBy("_s").applyInArrow(_cutoffs(alpha, delta), "_cs string, _cut int")
    joined = rows.join(small_side(cuts.where(F.col("_cut") < GRID)), F.col("_s") == F.col("_cs"), "left")
    hit = ~F.col("base_failed") & F.coalesce(F.col("place") >= F.col("_cut"), F.lit(False))
    rejected = F.when(hit, F.col("rule"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & rejected.isNull()).alias("kept"), rejected.alias("rejected_by"))
