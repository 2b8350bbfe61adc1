"""Documents with the awkward cases that every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Extra columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, bucket string, block int, _source string, h double, `a.b` int"


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"{rng.choice('abcdefghij')}w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(seed: int = 0, n: int = 60) -> list[tuple]:
    """(doc_id, text): nulls, empty and long texts, exact and near copies, shared passages, repeated rows."""
    rng = random.Random(seed)
    passage = sentence(rng, 60, 5000)
    base = [sentence(rng, rng.choice([0, 1, 3, 5, 20, 80, 200]), 3000) for _ in range(n)]
    out = [(k * 3 + 1, t) for k, t in enumerate(base)]
    at = 1000
    for k in range(0, n, 4):  # copies, exact and with one word changed
        words = base[k].split()
        out.append((at, base[k]))
        if len(words) > 30:
            words[len(words) // 2] = "changed"
            out.append((at + 1, "  ".join(words).upper() if k % 8 else "\t".join(words)))
        at += 2
    for k in range(12):  # a passage in many documents
        out.append((2000 + k, f"{sentence(rng, 30, 9000)} {passage}\n{sentence(rng, 10, 9000)} é€😀"))
    out += [(3000, "word " * 300), (3001, None), (3002, ""), (3003, " \n\t "), (None, passage), (None, "alone here"), (3004, sentence(rng, 30_000, 50_000))]
    out += [(3005, "x" * 500), (3006, "x" * 480), (1, base[0]), (4, base[1]), (4, passage)]
    rng.shuffle(out)
    return out


def documents(spark: SparkSession, rows_: list[tuple], parts: int = 5) -> DataFrame:
    langs, sources = ["en", "de", None], ["web", "web", "web", "books", None]
    full = [(d, t, langs[k % 3], sources[k % 5], len(t) if t is not None else None, "b", k, "s", 0.5, 1) for k, (d, t) in enumerate(rows_)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def as_set(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows in a fixed order."""
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
