"""Conversation structure repair: the cheapest edits after which roles alternate.

A repaired conversation reads, in initials of its roles, `(s?(ua)+)?`. The edits form a lattice
of nodes (rows read, grammar state): Keep, Rerole and Delete read a row, Insert reads none, and
each leads to one node, as grammar states decide the role that Rerole and Insert give. Dijkstra's
algorithm takes nodes by (cost, audit), where the audit holds the edits' initials, and stops at
the first accepting node behind the last row that it pops. Of two equally dear audits of one node
neither is the other's beginning (what follows would be insertions, which cost), so what comes
later can't turn their order round, and the least audit of each node is enough.

For the same reason lattices of consecutive rows can be joined: for each state at the start of a
stretch of STRETCH rows the best way to each state at its end is found by the same search, and
the heads of all states are carried on, without the beginning that they share. So a conversation
costs time in proportion to its rows, and besides its texts no more memory than its audit.

Scale. One shuffle by conversation, sorted inside the partition; a task holds one conversation.
Conversations of more than ROWS rows or BYTES of text go another way with the same result: repeats
are found by a window over (conversation, role, text), a first stream over the sorted rows keeps
flags and no texts and gives the audit, and a second one gets the audit ahead of the sorted rows
and edits each as it comes. Neither holds more than an audit and a batch.

Defined cases: a null role or text is one space (and so blank, or of no known role), a null turn
sorts first and counts in no gap, a null conv_id is a conversation of its own. Rows of one turn
go by role and text; repeated rows are duplicates. Roles are judged by their first character, an
empty role has none. A conversation without rows gives zeros and an empty audit. An empty table
gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.cluster import cut, small_side

#: What edits cost, and what a truncated row costs that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of a stretch of the lattice; rows and bytes of a conversation that a task holds at once.
STRETCH, ROWS, BYTES = 512, 50_000, 32 << 20
SPACE = " \t\n\v\f\r"

#: Grammar states: nothing yet, after system, after user, after assistant. The second and the last accept no end.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_ACCEPTS = (START, ASSISTANT)
_LEGAL = {"su", "ua", "au"}

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "conv_id long, position long, edit string, role string, text string"


def given(state: int) -> tuple[int, str]:
    """The state after the role that Rerole and Insert give there, and that role."""
    return (ASSISTANT, "assistant") if state == USER else (USER, "user")


def ways(rows: list[tuple[str, bool, bool]], start: int, until: Callable[[int], bool] | None = None) -> dict[int, tuple[int, str]]:
    """Grammar state behind the last row: (cost, audit) of the best way from `start`. Ends at the first state that `until` takes.

    A row is (initial of the role, must be deleted, truncated).
    """
    heap, done, ends, last = [(0, "", 0, start)], set(), {}, len(rows)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == last:
            ends[state] = cost, audit
            if until is not None and until(state):
                break
        else:
            initial, bad, short = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if not bad:
                stays = cost + TRUNCATED * short
                kept = _NEXT.get((state, initial))
                if kept is not None:
                    heapq.heappush(heap, (stays + KEEP, audit + "K", i + 1, kept))
                heapq.heappush(heap, (stays + REROLE, audit + "R", i + 1, given(state)[0]))
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, given(state)[0]))
    return ends


class Lattice:
    """The best ways through the rows so far, a stretch at a time."""

    def __init__(self):
        self.heads, self.shared, self.rows = {START: (0, "")}, [], []

    def add(self, row: tuple[str, bool, bool]) -> None:
        self.rows.append(row)
        if len(self.rows) == STRETCH:
            self._join(self.rows, None)
            self.rows = []

    def _join(self, rows, until) -> None:
        best: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in self.heads.items():
            for end, (more, rest) in ways(rows, state, until).items():
                way = cost + more, audit + rest
                if end not in best or way < best[end]:
                    best[end] = way
        same = os.path.commonprefix([audit for _, audit in best.values()])
        self.shared.append(same)
        self.heads = {state: (cost, audit[len(same) :]) for state, (cost, audit) in best.items()}

    def finish(self) -> tuple[int, str]:
        """(cost, audit) of the whole."""
        self._join(self.rows, _ACCEPTS.__contains__)
        cost, audit = min(way for state, way in self.heads.items() if state in _ACCEPTS)
        return cost, "".join(self.shared) + audit


def blank(text: str) -> bool:
    return not text.strip(SPACE)


def truncated(text: str) -> bool:
    return text.rstrip(SPACE)[-1:] not in (".", "!", "?")


class Conversation:
    """Counts of one conversation's rows in order, and its lattice."""

    def __init__(self):
        self.lattice, self.before = Lattice(), None
        self.low = self.high = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None and (self.high is None or turn != self.high):  # turns ascend
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in _LEGAL
        self.before = initial
        empty = blank(text)
        short = not empty and not seen and truncated(text)
        self.blank += empty
        self.duplicate += not empty and seen
        self.truncated += short
        self.lattice.add((initial, empty or seen, short))

    def summary(self) -> tuple:
        cost, audit = self.lattice.finish()
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


class Editor:
    """Applies an audit to the rows as they come: (edit, role, text) of each repaired row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state, role = given(self.state)
            yield "I", role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _NEXT[self.state, role[:1]]
        elif edit == "R":
            self.state, role = given(self.state)
        if edit != "D":
            yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


class _Lines:
    """The checksum of role:text lines."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == size or weight > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _rows(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for rb in stream:
        yield from zip(*(c.to_pylist() for c in rb.columns), strict=True)


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its rows): each is read to its end before the next."""
    rows = iter(rows)
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def run():
            nonlocal row
            while row is not None and row[0] == key:
                yield row
                row = next(rows, None)

        yield key, run()


def _repaired(audit: str, kept: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    editor = Editor(audit)
    for role, text in kept:
        yield from editor.row(role, text)
    yield from editor.end()


def _whole(turns: bool):
    """Conversations one at a time, held whole."""

    def out(stream):
        for key, run in _runs(_rows(stream)):
            seen, kept, conv = set(), [], Conversation()
            for _, turn, role, text, gone in run:
                if not gone:
                    conv.add(turn, role, text, (role, text) in seen)
                    seen.add((role, text))
                    kept.append((role, text))
            summary = conv.summary()
            repaired = _repaired(summary[-1], iter(kept))
            if turns:
                yield from ((key, k, *r) for k, r in enumerate(repaired))
            else:
                lines = _Lines()
                for _, role, text in repaired:
                    lines.add(role, text)
                yield key, *summary, lines.sha.hexdigest()

    schema = _schema(TURNS if turns else f"{SUMMARY}, repaired_sha256 string")
    return lambda stream: _batches(out(stream), schema)


def _summaries(stream):
    """Audits of sorted rows that know whether they are repeats; no text is held."""

    def out():
        for key, run in _runs(_rows(stream)):
            conv = Conversation()
            for _, turn, role, text, gone, seen in run:
                if not gone:
                    conv.add(turn, role, text, seen)
            yield key, *conv.summary()

    return _batches(out(), _schema(SUMMARY))


def _edited(turns: bool):
    """Each conversation's summary comes first, then its rows in order."""

    def out(stream):
        for key, run in _runs(_rows(stream)):
            summary = next(run)[5:]
            editor, lines, k = Editor(summary[-1]), _Lines(), 0

            def repaired(run=run, editor=editor):
                for row in run:
                    if not row[4]:
                        yield from editor.row(row[2], row[3])
                yield from editor.end()

            for edit, role, text in repaired():
                if turns:
                    yield key, k, edit, role, text
                    k += 1
                else:
                    lines.add(role, text)
            if not turns:
                yield key, *summary, lines.sha.hexdigest()

    schema = _schema(TURNS if turns else f"{SUMMARY}, repaired_sha256 string")
    return lambda stream: _batches(out(stream), schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults of the contract: (conv_id, turn, role, text, gone). Rows that go stay as marks, without text."""
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        kind.alias("kind"),
    )
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode(F.sequence(F.lit(1), "times")).alias("time")).drop("time")


def plain(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form that repair() takes."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(False).alias("gone")
    )



def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def repair(rows: DataFrame, turns: bool = False, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """One row per conversation with its faults, the edits' cost and audit and the repaired lines' checksum; or the repaired turns themselves.

    rows: (conv_id, turn, role, text, gone), of damaged() or plain().
    """
    out = TURNS if turns else f"{SUMMARY}, repaired_sha256 string"
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b"))
    large = cut(sizes.where(f"n > {most_rows} or b > {most_bytes}").select(F.col("conv_id").alias("_id")))
    if large.isEmpty():
        return _sorted(rows).mapInArrow(_whole(turns), out)
    large = small_side(large)
    same = F.col("conv_id").eqNullSafe(F.col("_id"))
    few = _sorted(rows.join(large, same, "left_anti")).mapInArrow(_whole(turns), out)
    many = rows.join(large, same, "left_semi")
    earlier = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    summaries = cut(_sorted(many.withColumn("seen", F.row_number().over(earlier) > 1)).mapInArrow(_summaries, SUMMARY))
    names = [c.split()[0] for c in SUMMARY.split(", ")][1:]
    first = summaries.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("gone"), *names)
    then = many.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "gone", *(F.lit(None).cast(summaries.schema[n].dataType).alias(n) for n in names))
    stream = first.unionByName(then).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text").drop("kind")
    return few.unionByName(stream.mapInArrow(_edited(turns), out))
