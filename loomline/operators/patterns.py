"""Row patterns over a group's ordered events: the first event that breaks an expected order.

A pattern becomes an automaton, and an event a mapping of its states. Mappings are put together by blocks of events: each block
in a task of its own, then the blocks of a group in order, then each block again from the state in which it begins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.segments import scan

#: Patterns are names of events, or tuples of one of these and patterns.
SEQ, ALT, OPT, STAR, ALL = "seq", "alt", "opt", "star", "all"
NOTHING, DEAD = (SEQ,), (ALT,)
#: Events of a group that are folded at a time.
BLOCK = 1024

#: What a worker emits for an item: its start, perhaps the probe's result, then readiness and the end of putting in any order, or a failure.
EMISSION = (SEQ, "started", (OPT, "probed"), (ALT, (ALL, "ready", "ready_put_done"), "failed"))


def _done(p) -> bool:
    """Whether the pattern may end here."""
    if isinstance(p, str):
        return False
    kind, parts = p[0], p[1:]
    return kind in (OPT, STAR) or (any if kind == ALT else all)(map(_done, parts))


def _seq(first, rest) -> tuple:
    if DEAD in (first, rest):
        return DEAD
    parts = [x for p in (first, rest) for x in (p[1:] if isinstance(p, tuple) and p[0] == SEQ else (p,))]
    return parts[0] if len(parts) == 1 else (SEQ, *parts)


def _alt(parts: Iterable) -> tuple:
    flat = {x for p in parts for x in (p[1:] if isinstance(p, tuple) and p[0] == ALT else (p,))}
    return next(iter(flat)) if len(flat) == 1 else (ALT, *sorted(flat, key=repr))


def _after(p, event: str):
    """What has to follow once the event has come."""
    if isinstance(p, str):
        return NOTHING if p == event else DEAD
    kind, parts = p[0], p[1:]
    if kind == ALT:
        return _alt(_after(x, event) for x in parts)
    if kind == OPT:
        return _after((SEQ, *parts), event)
    if kind == STAR:
        return _seq(_after((SEQ, *parts), event), p)
    if kind == ALL:
        return _alt(_seq(_after(x, event), (ALL, *parts[:i], *parts[i + 1 :]) if len(parts) > 1 else NOTHING) for i, x in enumerate(parts))
    if not parts:
        return DEAD
    rest = (SEQ, *parts[1:])
    first = _seq(_after(parts[0], event), rest)
    return _alt((first, _after(rest, event))) if _done(parts[0]) else first


def automaton(pattern) -> tuple[list[dict[str, int]], list[bool]]:
    """By state the next one by event, and whether the pattern may end there. State 0 is the start; events without a next state break the pattern."""

    def names(p) -> set[str]:
        return {p} if isinstance(p, str) else set().union(*map(names, p[1:]))

    states, steps = [pattern], []
    for state in states:
        to = {}
        for event in sorted(names(pattern)):
            after = _after(state, event)
            if after != DEAD:
                if after not in states:
                    states.append(after)
                to[event] = states.index(after)
        steps.append(to)
    return steps, [_done(s) for s in states]


def _mapping(event: Column, steps: list[dict[str, int]]) -> Column:
    """array<int>: the next state by state; one more than the last is that of broken groups."""
    broken = len(steps)
    out = F.array(*(F.lit(broken) for _ in range(broken + 1)))
    for name in {e for to in steps for e in to}:
        out = F.when(event == name, F.array(*(F.lit(to.get(name, broken)) for to in steps), F.lit(broken))).otherwise(out)
    return out


def first_break(events: DataFrame, group: list[str], order: list[str], event: str, pattern=EMISSION) -> DataFrame:
    """One row per group: its columns, n, at, event and verdict.

    ``complete`` is a group that ends where the pattern may, ``open`` one that needs more events, and ``broken`` one whose event number
    ``at``, from 0, can't come there. The order should tell events apart; null groups are groups and a null event breaks any pattern.
    """
    steps, done = automaton(pattern)
    broken = len(steps)
    placed = scan(events.select(*group, *(o for o in order if o not in group), F.coalesce(F.col(event), F.lit("")).alias("_event")), group, order, before="_at")
    keyed = placed.select(F.struct(*group).alias("g"), F.floor(F.col("_at") / BLOCK).alias("block"), F.struct(F.col("_at").alias("at"), F.col("_event").alias("event")).alias("e"))
    blocks = keyed.groupBy("g", "block").agg(F.sort_array(F.collect_list("e")).alias("e"))  # at most BLOCK events
    identity = F.array(*(F.lit(i) for i in range(broken + 1)))
    through = F.aggregate("e", identity, lambda m, x: F.transform(m, lambda s: F.element_at(_mapping(x["event"], steps), s + 1)))
    folded = blocks.withColumn("m", through)
    # A group has a mapping for every BLOCK events.
    chain = folded.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("c"))
    start = F.struct(F.lit(0).alias("state"), F.lit(-1).cast("long").alias("block"), F.lit(0).alias("begun"))
    step = lambda a, x: F.when(a["state"] == broken, a).otherwise(F.struct(F.element_at(x["m"], a["state"] + 1).alias("state"), x["block"].alias("block"), a["state"].alias("begun")))
    ends = chain.select("g", F.aggregate("c", start, step).alias("a")).select("g", "a.*")
    # Only the block in which a group breaks is gone through again.
    inside = F.aggregate(
        "e", F.struct(F.col("begun").alias("state"), F.lit(None).cast("struct<at: bigint, event: string>").alias("e")),
        lambda a, x: F.when(a["e"].isNotNull(), a).otherwise(_next(a, x, steps)),
    )
    sizes = keyed.groupBy("g").agg(F.count("*").alias("n"))
    where = blocks.withColumnsRenamed({"g": "_g", "block": "_b"}).join(ends.where(F.col("state") == broken), F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")))
    found = where.select(F.col("g").alias("_g"), inside["e"].alias("e"))
    out = ends.join(found, F.col("g").eqNullSafe(F.col("_g")), "left").drop("_g")
    out = out.join(sizes.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")))
    ended = F.element_at(F.array(*map(F.lit, done), F.lit(False)), F.col("state") + 1)
    verdict = F.when(F.col("state") == broken, "broken").when(ended, "complete").otherwise("open")
    return out.select(*(F.col(f"g.`{c}`").alias(c) for c in group), "n", "e.at", F.nullif("e.event", F.lit("")).alias("event"), verdict.alias("verdict"))


def _next(a: Column, x: Column, steps: list[dict[str, int]]) -> Column:
    state = F.element_at(_mapping(x["event"], steps), a["state"] + 1)
    return F.struct(state.alias("state"), F.when(state == len(steps), x).alias("e"))
