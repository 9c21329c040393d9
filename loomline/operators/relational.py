"""Merges, gates, summaries, placement and cache snapshots as DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators.segments import scan


def with_index(rows: DataFrame, group: str, order: list[str], name: str = "idx") -> DataFrame:
    """Rows numbered from 0 within their group, which may be of any size."""
    return scan(rows, [group], order, before=name).withColumn(name, F.col(name).cast("int"))


def manifest(items: DataFrame, group: str) -> DataFrame:
    """Image count and token total of each request."""
    return items.groupBy(group).agg(F.count("*").alias("image_count"), F.sum("tokens").alias("total_tokens"), F.max("tokens").alias("max_tokens"))


def coalesce_full(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer join on ``keys`` in which the right side's fields win and the left fills in."""
    joined = left.alias("l").join(right.alias("r"), keys, "full")
    return joined.select(*keys, *[F.coalesce(f"r.{f}", f"l.{f}").alias(f) for f in fields])


def set_default(base: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Rows of ``base`` with ``field`` from ``first``, else from ``second``; rows with neither go."""
    a, b = first.select(*keys, F.col(field).alias("_first")), second.select(*keys, F.col(field).alias("_second"))
    out = base.join(a, keys, "left").join(b, keys, "left").withColumn(field, F.coalesce("_first", "_second"))
    return out.where(F.col(field).isNotNull()).drop("_first", "_second")


def all_match(rows: DataFrame, group: str, ok: Column) -> DataFrame:
    """Rows of the groups in which every row is ok."""
    broken = rows.where(~F.coalesce(ok, F.lit(False))).select(F.col(group).alias("_g")).distinct()
    return rows.join(broken, F.col(group).eqNullSafe(F.col("_g")), "left_anti")


def sparse_summary(rows: DataFrame, group: str, row: str, key: str, value: str) -> DataFrame:
    """avg, max and sum of each key over all rows of a group; a row without the key counts as 0.

    The grid of rows and keys is never built: sums need the present values only, and zeros enter the
    maximum where a key has fewer rows than its group.
    """
    present = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    cells = present.groupBy(group, row, key).agg(F.max(value).alias(value))
    per_key = cells.groupBy(group, key).agg(F.sum(value).alias("s"), F.max(value).alias("m"), F.count("*").alias("n"))
    size = rows.groupBy(group).agg(F.countDistinct(row).alias("rows"))
    out = per_key.join(size, group)
    top = F.when(F.col("n") < F.col("rows"), F.greatest("m", F.lit(0.0))).otherwise(F.col("m"))
    return out.select(group, key, (F.col("s") / F.col("rows")).alias("avg"), top.alias("max"), F.col("s").alias("sum"))


def load_balance(sizes: Column, ranks: int) -> Column:
    """Longest first to the least loaded rank, ties to the lowest: a struct of loads and of each item's rank in placing order."""
    order = F.array_sort(F.transform(sizes, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), ranks).alias("loads"), F.array().cast("array<struct<i:int,r:int>>").alias("placed"))

    def place(a: Column, x: Column) -> Column:
        rank = F.array_position(a["loads"], F.array_min(a["loads"])).cast("int") - 1
        loads = F.transform(a["loads"], lambda v, k: F.when(k == rank, v - x["s"]).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(a["placed"], F.array(F.struct(x["i"].alias("i"), rank.alias("r")))).alias("placed"))

    return F.aggregate(order, zero, place)


def allocate(rows: DataFrame, order: list[str], count: str, group: str | None = None) -> DataFrame:
    """Disjoint consecutive ranges [start, stop) of ``count`` items in order, in each group or over all rows; a null count takes none."""
    out = scan(rows, [group] if group else [], order, F.col(count), before="start")
    return out.withColumn("stop", F.col("start") + F.coalesce(F.col(count), F.lit(0)))


def alive(cache: DataFrame, created: str, ttl: float, now: Column) -> DataFrame:
    """Entries that have not run out; reading an entry doesn't prolong it."""
    return cache.where(F.col(created) + ttl > now)


def within_budget(cache: DataFrame, group: str, last_used: list[str], size: str, budget: int) -> DataFrame:
    """The most recently used entries whose sizes together stay within the budget."""
    window = Window.partitionBy(group).orderBy(*[F.desc(c) for c in last_used]).rowsBetween(Window.unboundedPreceding, 0)
    return cache.withColumn("_total", F.sum(size).over(window)).where(F.col("_total") <= budget).drop("_total")


def newest(rows: DataFrame, group: str, order: list[str], per_group: int, groups: int) -> DataFrame:
    """The last rows of the groups that were first seen last."""
    first = rows.groupBy(group).agg(*[F.min(c).alias(f"_{c}") for c in order]).orderBy(*[F.desc(f"_{c}") for c in order]).limit(groups).select(group)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in order]))
    return rows.join(first, group, "left_semi").withColumn("_r", rank).where(F.col("_r") <= per_group).drop("_r")


def source_plan(rows: DataFrame, rank: int, claim: bool = True) -> DataFrame:
    """decision, producer_rank, reason and error from ``state``, ``claim_granted``, ``claim_state`` and ``owner_rank``.

    Without ``claim`` this is a preview. A denied claim that no rank owns is an error, without a decision.
    """
    if not claim:
        ready = F.coalesce(F.col("state") == "READY", F.lit(False))
        reason = F.when(ready, "ready_before_fallback").otherwise("preview_requires_fallback")
        producer = F.when(~ready, F.lit(rank))
        return rows.withColumns({"decision": F.when(ready, "USE_SIDECAR").otherwise("FALLBACK"), "producer_rank": producer.cast("int"), "reason": reason, "error": F.lit(None).cast("string")})
    ready, granted = F.coalesce(F.col("state") == "READY", F.lit(False)), F.coalesce(F.col("claim_granted"), F.lit(False))
    raced = F.coalesce(F.col("claim_state") == "READY", F.lit(False))
    owned = F.coalesce(F.col("claim_state").isin("FALLBACK_CLAIMED", "FALLBACK_LOCAL_DONE") & F.col("owner_rank").isNotNull(), F.lit(False))
    reason = F.when(ready, "ready_before_fallback").when(granted, "fallback_claim_granted").when(raced, "ready_after_claim_race").when(owned, "fallback_claim_already_owned")
    decision = F.when(ready, "USE_SIDECAR").when(granted, "FALLBACK").when(raced, "USE_SIDECAR").when(owned, "FALLBACK")
    producer = F.when(ready, None).when(granted, F.lit(rank)).when(raced, None).when(owned, F.col("owner_rank"))
    error = F.when(~(ready | granted | raced | owned), "fallback claim denied")
    return rows.withColumns({"decision": decision, "producer_rank": producer.cast("int"), "reason": reason, "error": error})


def placement(events: DataFrame, workers: int, group: str = "grp") -> DataFrame:
    """The worker of each submitted item: the least loaded one, ties to the lowest id. ``events(grp, seq, kind, worker)``.

    A ``submit`` adds to the load of the chosen worker; a ``finish`` takes one from its worker's, not below 0. The
    events of a group are folded in one task, as their order asks for: sorted by Spark and read as a stream, of which
    only the loads are held. Null is a group like others; events of equal seq stand by kind, then worker.
    """
    rows = events.select(F.col(group).alias("g"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("kind") == "submit", F.lit(False)).alias("submit"), F.col("worker").cast("int").alias("worker"), F.col("kind").alias("kind"))
    out = rows.select(F.col("g").alias(group), "seq", "worker").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, loads = None, [0] * workers
        for batch in batches:
            chosen = []
            for g, submit, worker in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if g != now and (g == g or now == now):  # a NaN is the same group as another
                    now, loads = g, [0] * workers
                if submit:
                    least = loads.index(min(loads))
                    loads[least] += 1
                    chosen.append(least)
                elif worker is not None and 0 <= worker < workers and loads[worker]:
                    loads[worker] -= 1
            placed = batch.filter(batch.column(2))
            yield pa.RecordBatch.from_arrays([placed.column(0), placed.column(1), pa.array(chosen, pa.int32())], out.names)

    return rows.repartition("g").sortWithinPartitions("g", "seq", "kind", "worker").mapInArrow(run, out)


def first_queued(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each queue, in order: what one poll takes."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def cache_fold(events: DataFrame, group: str, ttl: int, budget: int) -> DataFrame:
    """A cache's state after its events (group, seq, kind, key, size, at): hits, misses and the keys it holds.

    ``put`` replaces a key, lets it run out at at + ttl, and evicts the least recently used until all sizes are within the
    budget, which an item above the budget doesn't survive itself; ``get`` makes a key the last used one without prolonging it. A
    group's events are folded in one task, as their order asks for.
    """
    entry = "struct<key: string, size: bigint, used: bigint, expires: bigint>"
    zero = f"named_struct('e', CAST(array() AS array<{entry}>), 'hits', 0, 'misses', 0)"
    alive = "filter(s.e, v -> v.expires > x.at)"
    new = f"CAST(named_struct('key', x.key, 'size', x.size, 'used', x.seq, 'expires', x.at + {ttl}) AS {entry})"
    put = f"concat(filter({alive}, v -> v.key <> x.key), array({new}))"
    kept = f"transform(array({put}), l -> filter(l, v -> aggregate(filter(l, w -> w.used >= v.used), 0L, (t, w) -> t + w.size) <= {budget}))[0]"
    touched = f"transform({alive}, v -> CASE WHEN v.key = x.key THEN CAST(named_struct('key', v.key, 'size', v.size, 'used', x.seq, 'expires', v.expires) AS {entry}) ELSE v END)"
    hit = f"exists({alive}, v -> v.key = x.key)"
    step = f"""CASE WHEN x.kind = 'put' THEN named_struct('e', {kept}, 'hits', s.hits, 'misses', s.misses)
      ELSE named_struct('e', {touched}, 'hits', s.hits + CAST({hit} AS int), 'misses', s.misses + CAST(NOT {hit} AS int)) END"""
    rows = events.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "key", "size", "at"))).alias("e"))
    rows = rows.select(group, F.expr(f"aggregate(e, {zero}, (s, x) -> {step})").alias("s"))
    return rows.select(group, "s.hits", "s.misses", F.array_join(F.array_sort(F.transform("s.e", lambda v: v["key"])), ",").alias("keys"))


def allocate_within(rows: DataFrame, order: list[str], count: str, group: str, available: Column) -> DataFrame:
    """``allocate`` from a stock of ``available`` items a group; a range that reaches beyond it is an error."""
    out = allocate(rows, order, count, group)
    return out.withColumn("error", F.when(F.col("stop") > available, "not enough items left"))


def compare_modes(left: DataFrame, right: DataFrame, keys: list[str], modes: dict[str, list[str]]) -> DataFrame:
    """Rows of two extractions that differ, counted for each mode by the fields that it tells; a row on one side differs in every mode."""
    fields = sorted({f for own in modes.values() for f in own})
    a = left.select(*keys, F.lit(True).alias("_a"), *(F.col(f).alias(f"_a_{f}") for f in fields))
    b = right.select(*keys, F.lit(True).alias("_b"), *(F.col(f).alias(f"_b_{f}") for f in fields))
    both = a.join(b, keys, "full")
    one = F.col("_a").isNull() | F.col("_b").isNull()

    def differs(own: list[str]) -> Column:
        out = one
        for f in own:
            out = out | ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}"))
        return out

    counts = both.agg(*(F.count_if(differs(own)).alias(m) for m, own in modes.items()), F.count("*").alias("_n"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("mismatches"), F.col("_n").alias("rows")) for m in modes))).alias("r")).select("r.*")
