from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

from cases import as_set, documents, rows

from sparkreel.llm import queries, substring_dedup

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows_):
    seen = Counter(tuple(w[k : k + 35]) for _, t in rows_ if (w := words(t)) for k in range(len(w) - 34))
    out = []
    for d, t in rows_:
        w = words(t)
        gone = {i for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for i in range(k, k + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_cases(spark):
    r = rows(2)
    assert as_set(substring_dedup.remove_repeats(documents(spark, r)), *COLUMNS) == brute(r)


def test_table(spark, sf_dir):
    r = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert as_set(queries.op6_substring_dedup(spark, sf_dir), *COLUMNS) == brute(r)


def test_long_and_overlapping(spark):
    """A repeat of itself inside one document, a cycle, and matches at every shift modulo the period."""
    w = [f"v{k}" for k in range(200)]
    r = [(k, " ".join(w[k : k + 60] + [f"own{k}"] * (k % 3))) for k in range(70)]
    r += [(500, " ".join([f"c{k % 7}" for k in range(400)])), (501, " ".join(w[100:135] + ["gap"] + w[100:135])), (502, " ".join(f"z{k}" for k in range(34))), (503, " ".join(f"z{k}" for k in range(34)))]
    assert as_set(substring_dedup.remove_repeats(documents(spark, r)), *COLUMNS) == brute(r)


def test_every_row_is_a_document(spark):
    """Any id is allowed, and rows with one id lose only what repeats of their own text."""
    w, y = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("p", 40), ("q", 60)))
    for r in ([(-2, w), (5, w)], [(1, w), (1, y), (5, w)], [(None, y), (None, w), (5, w)], [(None, w), (-1, y), (7, w)], [(None, w), (-1, w)], [(3, w), (3, w)], [(-1, y), (None, y + " z")]):
        assert as_set(substring_dedup.remove_repeats(documents(spark, r)), *COLUMNS) == brute(r)


def first_places(rows_):
    """The words that stay in each row when the first place of each window does."""
    order = sorted(range(len(rows_)), key=lambda k: (-1 if rows_[k][0] is None else rows_[k][0], zlib.crc32((rows_[k][1] or "").encode())))
    seen, out = set(), {}
    for k in order:
        w = words(rows_[k][1])
        gone = set()
        for i in range(len(w) - 34):
            key = tuple(w[i : i + 35])
            if key in seen:
                gone.update(range(i, i + 35))
            seen.add(key)
        out[k] = [x for i, x in enumerate(w) if i not in gone]
    return [out[k] for k in range(len(rows_))]


def test_rewritten(spark):
    r = list(dict.fromkeys(rows(3)))
    df = documents(spark, r)
    got = substring_dedup.rewritten(df).collect()
    assert got[0].__fields__ == df.columns and len(got) == len(r)
    want = Counter((d, tuple(w)) for (d, _), w in zip(r, first_places(r), strict=True))
    assert Counter((x.doc_id, tuple(words(x.text))) for x in got) == want
    texts = Counter(r)
    for x in got:
        assert x.n_chars == (None if x.text is None else len(x.text))
        same = [t for d, t in texts if d == x.doc_id and words(t) == words(x.text)]
        assert not same or x.text in same  # nothing lost: nothing changed
    assert substring_dedup.rewritten(df.limit(0)).count() == 0


def test_lines_stay(spark):
    p = " ".join(f"p{k}" for k in range(20)) + "\n" + " ".join(f"p{k}" for k in range(20, 40))
    r = [(1, f"one {p} two"), (2, f"uno\n{p}\nzwei three\n"), (3, f"{p}\n\nend"), (4, f"start\n{p}"), (5, f"a {p} b {p}\nc"), (6, p)]
    got = {x.doc_id: x.text for x in substring_dedup.rewritten(documents(spark, r)).collect()}
    assert got == {1: r[0][1], 2: "uno\nzwei three\n", 3: "\n\nend", 4: "start", 5: "a b\nc", 6: ""}


def test_null_ids_and_empty(spark):
    p = " ".join(f"p{k}" for k in range(40))
    got = as_set(substring_dedup.remove_repeats(documents(spark, [(None, p), (5, p), (6, None)])), "doc_id", "n_words", "n_removed")
    assert got == sorted([(None, 40, 40), (5, 40, 40), (6, 0, 0)], key=repr)
    assert substring_dedup.remove_repeats(documents(spark, [(1, "x")]).limit(0)).count() == 0
