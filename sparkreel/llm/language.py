"""Language identification with language-bitmask n-gram filters.

An n-gram is GRAM bytes of the text after case folding (of Latin, Greek and Cyrillic letters;
other scripts with capitals have them as letters of their own), with runs of everything that
is no letter, among ASCII, as one blank. In scripts of several bytes a letter it is fewer letters. A profile holds, for each language, the PROFILE n-grams that are
in most of its training documents (and in MIN_DOCS at least). All profiles go into one
Bloom filter whose slots are bitmasks, one bit a language (a bit-sliced filter): the AND
of an n-gram's PROBES slots is the set of languages that contain it. A text's score for
a language is the share of its n-grams with that bit, corrected for false positives:
(hits - n * f) / (n * (1 - f)), where f is the language's fill to the power PROBES. The
highest score decides; ties go to the language first in order.

Training reads documents whose lang is not null and whose crc32(doc_id as text) modulo
FOLDS is not HELD_OUT, of each language about TRAIN_DOCS chosen by a hash of the id (a
bounded sample, as parameters). Every language gets a bit: a slot has one word for each
64 languages. The filter has at most PROFILE n-grams a language and 2**SLOT_BITS slots, so
its size (8 MB for each 64 languages) depends on their number only; it is sent to the tasks.
A language's fill does not depend on the others. Prediction is one pass without a shuffle
over whole texts.

Defined cases: null text and text without a letter are `und` with score 0. A text with
letters whose n-grams are in no language gets the first language with score 0. Null ids
are never held out and never trained on. Without any training document everything is
`und`. Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks as bl
from . import textkit as tk

GRAM, PROBES, SLOT_BITS = 4, 3, 20
TRAIN_DOCS, PROFILE, MIN_DOCS = 2000, 20_000, 2
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Bytes of text handled at once in a task.
SLICE = 1 << 18
#: Documents with a lower score are rejected by `known`.
LEAST_SCORE = 0.02

OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def _fold() -> np.ndarray:
    """Lower case for ASCII letters, blank for other ASCII."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    for b in range(128):
        if not (97 <= t[b] <= 122):
            t[b] = 32
    return t


_FOLD = _fold()
#: Capitals in two bytes: first byte, range of the second, distance of the small letters (Latin-1, Greek, Cyrillic).
_CAPITALS = ((0xC3, 0x80, 0x9E, 32), (0xCE, 0x91, 0xAB, 32), (0xD0, 0x90, 0xAF, 32), (0xD0, 0x80, 0x8F, 80))


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-grams of all rows; a blank stands before and after each row."""
    t = _FOLD[buf]
    for first, low, high, step in _CAPITALS:
        at = np.flatnonzero(buf[:-1] == first) + 1
        at = at[(buf[at] >= low) & (buf[at] <= high)]
        if first == 0xC3:
            at = at[buf[at] != 0x97]  # the multiplication sign
        moved = (buf[at] & 0x3F).astype(np.int64) + (step & 0x3F)
        t[at] = 0x80 | (moved & 0x3F)
        t[at - 1] = first + (moved >> 6) + (step >> 6)
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    # rows apart, each between blanks
    out = np.full(len(t) + 2 * len(n), 32, np.uint8)
    out[np.arange(len(t)) + 2 * row + 1] = t
    whose = np.repeat(np.arange(len(n)), n + 2)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32) | (whose[1:] != whose[:-1])
    out, whose = out[keep], whose[keep]
    m = len(out) - GRAM + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for k in range(GRAM):
        h = (h << np.uint64(8)) | out[k : m + k].astype(np.uint64)
    ok = whose[:m] == whose[GRAM - 1 :]
    return tk.mix(h[ok]), whose[:m][ok]


def _profile(stream):
    """(language, n-gram, documents) of a task's training documents."""
    seen: dict[str, list[np.ndarray]] = {}
    for rb in stream:
        langs = rb.column(0).to_pylist()
        for a, b, buf, off in tk.text_slices(rb, "text", SLICE):
            h, row = grams(buf, off)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
            names = np.array(langs[a:b], object)[row[new]]
            for lang in set(langs[a:b]):
                seen.setdefault(lang, []).append(h[new][names == lang])
    for lang, parts in seen.items():
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "docs"])


class Filter:
    """The bit-sliced Bloom filter of all languages."""

    def __init__(self, languages: list[str], slots: np.ndarray):
        self.languages, self.slots = languages, slots
        self.false = np.array([float(((slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) ** PROBES for k in range(len(languages))])

    @staticmethod
    def _places(h: np.ndarray):
        for k in range(PROBES):
            yield (tk.mix(h, 20 + k) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    @classmethod
    def build(cls, profiles: dict[str, np.ndarray]) -> Filter:
        names, slots = sorted(profiles), np.zeros((-(-len(profiles) // 64), 1 << SLOT_BITS), np.uint64)
        for k, name in enumerate(names):
            for at in cls._places(profiles[name]):
                slots[k // 64, at] |= np.uint64(1) << np.uint64(k % 64)
        return cls(names, slots)

    def scores(self, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Corrected share of n-grams by row and language."""
        places = list(self._places(h))
        n = np.bincount(row, minlength=rows).astype(float)
        edge = np.searchsorted(row, np.arange(rows + 1))
        out = np.zeros((rows, len(self.languages)))
        for k, f in enumerate(self.false):
            if k % 64 == 0:
                mask = self.slots[k // 64][places[0]]
                for at in places[1:]:
                    mask &= self.slots[k // 64][at]
            total = np.append(0, np.cumsum(((mask >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int64)))
            hits = total[edge[1:]] - total[edge[:-1]]
            out[:, k] = np.clip((hits - n * f) / np.maximum(n * (1 - f), 1e-9), 0, 1)
        return out


def has_letters(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether a row holds a letter of any script."""
    ascii_ = np.append(0, np.cumsum((buf < 128) & (_FOLD[buf] != 32)))
    out = ascii_[off[1:]] > ascii_[off[:-1]]
    for k in np.flatnonzero(~out & (off[1:] > off[:-1])).tolist():
        out[k] = any(c.isalpha() for c in buf[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def fitted(docs: DataFrame) -> Filter | None:
    """The filter for the languages of the training documents."""
    known = docs.where("lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    most = known.groupBy(F.col("lang").cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").collect()
    if not most:
        return None
    share = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, TRAIN_DOCS / r["count"])) for r in most], "lang string, _share double"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    chosen = known.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).join(share, "lang").where(part < F.col("_share"))
    grams_ = chosen.selectExpr("cast(lang as string) lang", "cast(text as string) text").mapInArrow(_profile, "lang string, gram long, docs long")
    totals = grams_.groupBy("lang", "gram").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS)
    best = W.partitionBy("lang").orderBy(F.desc("docs"), "gram")  # of each at most PROFILE numbers
    top = totals.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= PROFILE).select("lang", "gram").toPandas()
    profiles = {r["lang"]: np.zeros(0, np.uint64) for r in most}
    profiles |= {lang: g.to_numpy(np.int64).view(np.uint64) for lang, g in top.groupby("lang")["gram"]}
    return Filter.build(profiles)


def predictor(model: Filter | None):
    """A function of a batch of texts: (languages, scores)."""

    def predict(rb: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for a, b, buf, off in tk.text_slices(rb, "text", SLICE):
            ok = has_letters(buf, off)
            if model is None:
                names += [UNKNOWN] * (b - a)
                scores.append(np.zeros(b - a))
                continue
            h, row = grams(buf, off)
            s = model.scores(h, row, b - a)
            best = s.argmax(axis=1)
            names += [model.languages[k] if good else UNKNOWN for k, good in zip(best.tolist(), ok.tolist(), strict=True)]
            scores.append(np.where(ok, s[np.arange(b - a), best], 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fitted(docs))

    def run(stream):
        predict = predictor(model.value)
        for rb in stream:
            names, scores = predict(rb)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def known(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a language: not `und`, and a score of LEAST_SCORE or more. Columns stay."""
    spark = docs.sparkSession
    model, at = spark.sparkContext.broadcast(fitted(docs)), docs.columns.index("text")
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names may hold dots

    def run(stream):
        predict = predictor(model.value)
        for rb in stream:
            one = pa.RecordBatch.from_arrays([rb.column(at).cast(pa.string())], names=["text"])
            names, scores = predict(one)
            yield rb.filter(pa.array([n != UNKNOWN and s >= LEAST_SCORE for n, s in zip(names, scores.tolist(), strict=True)], pa.bool_()))
        bl.give_back()

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
