"""Repair of conversations by error-correcting Earley parsing.

A weighted grammar of roles derives what a conversation should be, an optional system turn and then pairs of user and assistant,
with productions that delete a row, give it another role or insert a turn. Chart items keep the least (cost, audit), the audit
being the edits' initials in order, and the completed chart gives the cheapest repair.

Conversations are parsed in blocks of rows. The grammar is left-linear, so what a block does to a parse is told by the least
(cost, audit) from each open nonterminal to each other; a conversation's blocks are parsed in different tasks, and their few
results put together in order. Two equally cheap audits of the same rows are never prefixes of each other, so the least of a
whole is made of the least of its parts.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.segments import scan

from .common import discard, hot_join, save, slices

Value = tuple[int, str]


class Row(NamedTuple):
    """What the grammar sees of a row: its role's initial, whether it must go, and what it costs to leave it in."""

    initial: str
    faulty: bool
    extra: int


class Edit(NamedTuple):
    """A terminal: its letter in the audit, its cost, and the initial of the rows it takes (empty: any row, None: no row)."""

    letter: str
    cost: int
    takes: str | None


EDITS = {
    "keep system": Edit("K", 0, "s"), "keep user": Edit("K", 0, "u"), "keep assistant": Edit("K", 0, "a"),
    "rerole": Edit("R", 1, ""), "delete": Edit("D", 2, ""), "insert": Edit("I", 5, None),
}
#: Productions. A nonterminal of OPEN derives the rows from the parse's start up to one whose role it names.
GRAMMAR = (
    ("nothing", ("nothing", "delete")),
    ("system", ("nothing", "keep system")), ("system", ("system", "delete")),
    ("user", ("nothing", "user turn")), ("user", ("system", "user turn")), ("user", ("assistant", "user turn")), ("user", ("user", "delete")),
    ("assistant", ("user", "assistant turn")), ("assistant", ("assistant", "delete")),
    ("user turn", ("keep user",)), ("user turn", ("rerole",)), ("user turn", ("insert",)),
    ("assistant turn", ("keep assistant",)), ("assistant turn", ("rerole",)), ("assistant turn", ("insert",)),
)
OPEN, ACCEPTED = ("nothing", "system", "user", "assistant"), ("nothing", "assistant")
#: Rows that are parsed at a time; parses of up to SHORT rows are remembered, KEPT of them, as few kinds of rows make them up.
BLOCK, SHORT, KEPT = 4096, 32, 1 << 14


def applied(edit: Edit, row: Row) -> int | None:
    """The cost of an edit of a row; None if it doesn't take it."""
    if edit.letter == "D":
        return edit.cost
    if edit.takes is None or row.faulty or edit.takes not in ("", row.initial):
        return None
    return edit.cost + row.extra


def parse(rows: Iterable[Row], entry: str = "nothing") -> dict[str, Value]:
    """The least (cost, audit) by which the rows lead from the entry to each nonterminal of OPEN.

    An item is (production, dot, origin). A set of the chart is dropped when no item of the last one began there.
    """
    grammar = (*GRAMMAR, (entry, ()))
    of: dict[str, list[int]] = {}
    for i, (left, _) in enumerate(grammar):
        of.setdefault(left, []).append(i)
    waiting: dict[int, dict[str, list[tuple[tuple, Value]]]] = {}
    seeds = {(i, 0, 0): (0, "") for left in OPEN for i in of[left]}
    rows, at = iter(rows), 0
    while True:
        best: dict[tuple, Value] = {}
        agenda: list[tuple[Value, tuple]] = []
        empty: dict[str, Value] = {}  # nonterminals that derive no row here
        asking: dict[str, set[tuple]] = {}

        def put(item: tuple, value: Value) -> None:
            if item not in best or value < best[item]:
                best[item] = value
                heapq.heappush(agenda, (value, item))

        def step(item: tuple, value: Value, more: Value) -> None:
            put((item[0], item[1] + 1, item[2]), (value[0] + more[0], value[1] + more[1]))

        for item, value in seeds.items():
            put(item, value)
        while agenda:
            value, item = heapq.heappop(agenda)
            if best[item] != value:
                continue
            (left, right), dot, origin = grammar[item[0]], item[1], item[2]
            if dot == len(right):
                if origin == at:
                    if left not in empty or value < empty[left]:
                        empty[left] = value
                        for parent in list(asking.get(left, ())):
                            step(parent, best[parent], value)
                else:
                    for parent, before in waiting[origin].get(left, ()):
                        step(parent, before, value)
            elif (symbol := right[dot]) in of:
                asking.setdefault(symbol, set()).add(item)
                for i in of[symbol]:
                    put((i, 0, at), (0, ""))
                if symbol in empty:
                    step(item, value, empty[symbol])
            elif EDITS[symbol].takes is None:
                step(item, value, (EDITS[symbol].cost, EDITS[symbol].letter))
        row = next(rows, None)
        if row is None:
            ends = [(grammar[i][0], v) for (i, dot, origin), v in best.items() if origin == 0 and dot == len(grammar[i][1]) and grammar[i][0] in OPEN]
            return {left: min(v for name, v in ends if name == left) for left in {name for name, _ in ends}}
        waiting[at] = {symbol: [(item, best[item]) for item in items] for symbol, items in asking.items()}
        seeds, at = {}, at + 1
        for item, value in best.items():
            right = grammar[item[0]][1]
            edit = EDITS.get(right[item[1]]) if item[1] < len(right) else None
            if edit and (cost := applied(edit, row)) is not None:
                seeds[item[0], item[1] + 1, item[2]] = (value[0] + cost, value[1] + edit.letter)
        used = {item[2] for item in seeds} | {0}
        waiting = {k: v for k, v in waiting.items() if k in used}


@lru_cache(KEPT)
def _remembered(rows: tuple[Row, ...], entry: str) -> dict[str, Value]:
    return parse(rows, entry)


def put_together(blocks: Iterable[list[tuple[str, str, int, str]]]) -> Value:
    """The least (cost, audit) of a conversation from what each of its blocks does: (from, to, cost, audit)."""
    now: dict[str, Value] = {"nothing": (0, "")}
    settled: list[str] = []
    for moves in blocks:
        reached: dict[str, Value] = {}
        for source, to, cost, audit in moves:
            if source in now:
                value = now[source][0] + cost, now[source][1] + audit
                reached[to] = min(reached.get(to, value), value)
        # What all open audits begin with is certain and isn't carried along.
        same = len(os.path.commonprefix([audit for _, audit in reached.values()]))
        settled.append(next(iter(reached.values()))[1][:same])
        now = {to: (cost, audit[same:]) for to, (cost, audit) in reached.items()}
    cost, audit = min(now[end] for end in ACCEPTED if end in now)
    return cost, "".join(settled) + audit


def follow(audit: Iterable[str], rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """The repaired (edit, role, text) that an audit makes of (role, text) rows."""
    rows, turn = iter(rows), 0
    for i, letter in enumerate(audit):
        if letter == "I":
            yield letter, ("user", "assistant")[turn], ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            if letter == "K" and turn == 0 and role[:1] == "s":
                yield letter, role, text
                continue
            yield letter, ("user", "assistant")[turn] if letter == "R" else role, text
        turn = 1 - turn


BLANKS = " \t\n\x0b\x0c\r"
_MOVES = "array<struct<source: string, to: string, cost: long, audit: string>>"
_BLOCKS = f"conv_id long, block long, blank long, duplicate long, truncated long, illegal long, first string, last string, moves {_MOVES}"
_REPORT = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {"su", "ua", "au"}


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows of equal first columns, one run after the other; a run has to be read before the next is asked for."""

    def each() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    rows = each()
    ahead = [next(rows, None)]
    while ahead[0] is not None:
        key = ahead[0][:keys]

        def run() -> Iterator[tuple]:
            while ahead[0] is not None and ahead[0][:keys] == key:
                row, ahead[0] = ahead[0], next(rows, None)
                yield row

        yield key, run()


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, bounded by rows and by the bytes of their strings."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types)], schema.names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types)], schema.names)


_KINDS = {"long": pa.int64(), "string": pa.string()}


def _arrow(ddl: str) -> pa.Schema:
    move = pa.list_(pa.struct([("source", pa.string()), ("to", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
    pairs = [f.split(" ", 1) for f in ddl.replace(_MOVES, "moves").split(", ")]
    return pa.schema([(n, move if k == "moves" else _KINDS[k]) for n, k in pairs])


def _parsed(rows: DataFrame) -> DataFrame:
    """_BLOCKS from ``rows(conv_id, at, total, initial, fault)``."""
    schema = _arrow(_BLOCKS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, block), run in _runs(batches, 2):
            rows = list(run)  # at most BLOCK
            faults, initials = [r[5] for r in rows], [r[4] or "" for r in rows]
            seen = [Row(i, f in ("blank", "duplicate"), 5 * (f == "truncated")) for i, f in zip(initials, faults)]
            chart = lambda e: _remembered(tuple(seen), e) if len(seen) <= SHORT else parse(seen, e)
            entries = ("nothing",) if rows[0][3] <= BLOCK else ("nothing",) if block == 0 else OPEN
            moves = [{"source": e, "to": to, "cost": cost, "audit": audit} for e in entries for to, (cost, audit) in chart(e).items()]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            yield conv, block, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, initials[0], initials[-1], moves

    block = F.floor(F.col("at") / BLOCK)
    dealt = rows.select("conv_id", block.alias("block"), "at", "total", "initial", "fault").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    return dealt.mapInArrow(lambda batches: _batches(blocks(batches), schema), _BLOCKS)


def _joined(blocks: DataFrame) -> DataFrame:
    """_REPORT of each conversation from its _BLOCKS."""
    schema = _arrow(_REPORT)

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), run in _runs(batches, 1):
            counts, last = [0, 0, 0, 0], None

            def moves() -> Iterator[list]:
                nonlocal last
                for _, _, *found, first, end, steps in run:
                    counts[:] = [a + b for a, b in zip(counts, found)]
                    counts[3] += last is not None and last + first not in LEGAL
                    last = end
                    yield [tuple(s.values()) for s in steps]

            cost, audit = put_together(moves())
            yield conv, *counts, cost, audit

    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(lambda batches: _batches(reports(batches), schema), _REPORT)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation, and the repaired rows
    (conv_id, place, edit, role, text), which come with each conversation in one partition and in order.

    Rows of ``turns(conv_id, turn, role, text)`` stand by turn (null first), then role and the digest of the text; null roles
    and texts count as empty, rows of a null conv_id are one conversation, other columns are ignored. A text is blank without
    anything but ASCII blanks; a row is a duplicate if an earlier one has its role and text. An empty table gives no rows.
    A conversation of any length is parsed in several tasks; its repaired rows are streamed through one, which holds the audit.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    clean = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    own = F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.hex("digest"), "role")
    narrow = save(clean.select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), own.alias("own"), F.unhex(F.sha2(key, 256)).alias("key")))
    # Equal rows differ in their places in the table, so that they needn't meet in one task.
    placed = save(scan(narrow.withColumn("tie", F.monotonically_increasing_id()), ["conv_id"], ["turn", "role", "digest", "tie"], before="at", total="total"))
    firsts = save(placed.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("copies")))
    rows = hot_join(placed.select("conv_id", "at", "total", "initial", "own", "key"), firsts, "key", "copies", firsts.agg(F.sum("copies")).first()[0] or 0)
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("own"))
    told = save(_joined(_parsed(rows.withColumn("fault", fault))))
    discard(placed, firsts)
    spans = narrow.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")).withColumnRenamed("conv_id", "_conv")
    report = told.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    report = report.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))

    none = F.lit(None)
    heads = told.select("conv_id", F.lit(0).alias("tag"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), F.col("audit").alias("text"))
    both = heads.unionByName(clean.select("conv_id", F.lit(1).alias("tag"), F.col("turn").cast("long").alias("turn"), "role", "digest", "text"))
    stream = both.repartition("conv_id").sortWithinPartitions("conv_id", "tag", "turn", "role", "digest").select("conv_id", "tag", "role", "text")
    out = "conv_id long, place long, edit string, role string, text string"
    schema = _arrow(out)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cut = (part for batch in batches for part in slices(batch, 3, 2000))
        for (conv,), run in _runs(cut, 1):
            audit = next(run)[3]
            for place, (edit, role, text) in enumerate(follow(audit, ((r[2], r[3]) for r in run))):
                yield conv, place, edit, role, text

    return report, stream.mapInArrow(lambda batches: _batches(repaired(batches), schema), out)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, the hex digest of role:text joined by line ends, of ``repair``'s rows, read as a stream."""
    out = "conv_id long, repaired_sha256 string"
    schema = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), rows in _runs(batches, 1):
            sha = hashlib.sha256()
            for _, place, _, role, text in rows:
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield conv, sha.hexdigest()

    return repaired.mapInArrow(lambda batches: _batches(run(batches), schema), out)


def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of conv_id:turn modulo 20: 0 drops them, 1 empties the text, 2 takes its stops, 3 repeats them, 4 makes
    the user say them. Nulls in role and text, and in what is hashed, are one space."""
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(space(F.col("conv_id")), F.lit(":"), space(F.col("turn"))).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space(F.col("role")).alias("role"), space(F.col("text")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns``, damaged and repaired: ``repair``'s report and ``repaired_sha256``.

    A conversation without rows after the damage has zeros, an empty audit and the digest of the empty string.
    """
    report, rows = repair(damage(turns))
    ids = turns.select("conv_id").distinct()
    by = lambda df, name: df.withColumnRenamed("conv_id", name)
    out = ids.join(by(report, "_r"), F.col("conv_id").eqNullSafe(F.col("_r")), "left").join(by(digests(rows), "_d"), F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    counts = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
