from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from sparkreel.llm import conversations, queries

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, kind int, gone string"


def brute_damage(rows):
    """{conv_id: [(turn, role, text)]} in order."""
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        held += [(turn, role, text)] * (2 if kind == 3 else 1)
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def brute_repair(rows):
    """The least (cost, audit) over all audits, by a recursion from the end; then what it makes."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)

    grammar = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        """Cheapest rest from row i on; `last` is the last initial given out."""
        ways = [(0, "")] if i == len(rows) and last in ("", "a") else []
        new = "a" if last == "u" else "u"
        if inserted < 2:
            c, a = best(i, new, inserted + 1)
            ways.append((c + 2, "I" + a))
        if i < len(rows):
            c, a = best(i + 1, last, 0)
            ways.append((c + 3, "D" + a))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                initial = rows[i][1][:1]
                if initial and initial in grammar[last]:
                    c, a = best(i + 1, initial, 0)
                    ways.append((c + extra, "K" + a))
                c, a = best(i + 1, new, 0)
                ways.append((c + extra + 2, "R" + a))
        return min(ways, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    out, i = [], 0
    for edit in audit:
        need = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            out.append((need, ""))
        else:
            if edit == "K":
                out.append(rows[i][1:])
            elif edit == "R":
                out.append((need, rows[i][2]))
            i += 1
    assert i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        faults.count("blank"),
        faults.count("duplicate"),
        faults.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def brute(rows):
    return sorted(((c, *brute_repair(tuple(held))) for c, held in brute_damage(rows).items()), key=repr)


def found(df):
    return sorted(map(tuple, df.select(*NAMES).collect()), key=repr)


def awkward(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([0, 1, 2, 3, 6, 12])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "what", " \t\n", "", None, f"text {rng.randrange(9)}. ", "é€😀?", " ", "a.b"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + rng.randrange(4), None]), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_awkward_rows(spark, seed):
    rows = awkward(seed)
    assert found(conversations.repair(conversations.damaged(frame(spark, rows)))) == brute(rows)


def test_large_conversations_go_another_way(spark):
    rows = awkward(9)
    df = conversations.damaged(frame(spark, rows))
    for most_rows, most_bytes in ((0, 1 << 20), (4, 1 << 20), (100, 20)):
        assert found(conversations.repair(df, most_rows=most_rows, most_bytes=most_bytes)) == brute(rows)


def test_long_conversation_in_stretches(spark):
    """A third of all rows in one conversation: the same audit whole, in stretches and by brute force."""
    rng = random.Random(3)
    rows = [(7, k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", f"t {k}.", "cut off", ""])) for k in range(180)]
    rows += [(100 + k // 3, k % 3, "user", f"hello {k}.") for k in range(360)]
    want, got = brute(rows), {}
    for size in (1, 7, 64, 4096):
        lattice = conversations.STRETCH
        for conv, held in brute_damage(rows).items():
            conversations.STRETCH = size
            try:
                one, seen = conversations.Conversation(), set()
                for turn, role, text in held:
                    one.add(turn, role, text, (role, text) in seen)
                    seen.add((role, text))
                got[conv] = (conv, *one.summary())
            finally:
                conversations.STRETCH = lattice
        assert sorted(got.values(), key=repr) == [w[:-1] for w in want]
    assert found(conversations.repair(conversations.damaged(frame(spark, rows)), most_rows=100)) == want


def test_time_grows_with_the_rows():
    """100,000 rows of one conversation: heads are carried on without what they share."""
    one = conversations.Conversation()
    for k in range(100_000):
        one.add(k, ("user", "assistant", "tool")[k % 7 % 3], f"t {k}", False)
    gaps, *_, cost, audit = one.summary()
    assert gaps == 0 and cost > 0 and sum(c != "I" for c in audit) == 100_000


def test_turns_are_the_repaired_rows(spark):
    rows = awkward(5)
    df = conversations.damaged(frame(spark, rows))
    want = {w[0]: w[-1] for w in brute(rows)}
    for kw in ({}, {"most_rows": 3}):
        got = {}
        for r in conversations.repair(df, turns=True, **kw).orderBy("conv_id", "position").collect():
            assert r.position == len(got.setdefault(r.conv_id, []))
            got[r.conv_id].append(f"{r.role}:{r.text}")
        assert {c: hashlib.sha256("\n".join(got.get(c, [])).encode()).hexdigest() for c in want} == want


def test_plain_rows_and_empty_table(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello.")]
    (got,) = conversations.repair(conversations.plain(frame(spark, rows))).collect()
    assert (got.cost, got.audit, got.illegal) == (0, "KKK", 0)
    none = frame(spark, rows).where(F.lit(False))
    assert conversations.repair(conversations.damaged(none)).collect() == []


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_conversation_repair(spark, sf_dir)) == brute(rows)
