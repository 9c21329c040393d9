"""Running sums and latest values within groups of any size.

Groups that a task can sort go through a window. The few beyond that are laid over ranges of (group, order): a window goes over
each range by itself, and what a group brings from the ranges before it comes in a second step.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.tables import written

#: A group of more rows than LEAST, and than a SHARE of all, is laid over several tasks; there are at most 1 / SHARE of them.
LEAST, SHARE = 1 << 14, 1e-4


def same(keys: list[str], mark: str) -> Column:
    """Equality of the keys with those of the same names behind a mark; nulls are equal."""
    return reduce(and_, (F.col(k).eqNullSafe(F.col(mark + k)) for k in keys))


def marked(rows: DataFrame, keys: list[str], mark: str) -> DataFrame:
    return rows.withColumnsRenamed({k: mark + k for k in keys})


def large_groups(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys of the groups that are too large for a task, at most 1 / SHARE of them; None if there are none. One job."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.sum("_n").alias("all"), F.max("_n").alias("most")).first()
    limit = max(LEAST, int((most["all"] or 0) * SHARE))
    return sizes.where(F.col("_n") > limit).drop("_n") if (most["most"] or 0) > limit else None


def _carried(rows: DataFrame, group: list[str], order: list[str], value: Column, running, summary, joined, names: list[str]) -> DataFrame:
    """``rows`` with ``names``: ``running`` gives columns b and t over a window of v, ``summary`` an aggregate s of a range's v, and ``joined``
    the results from b, t and a range's carry and all, which are the summary over the ranges before and over all of them."""
    keys, places = [f"g{i}" for i in range(len(group))] or ["g0"], [f"o{i}" for i in range(len(order))]
    given = [F.col(g) for g in group] or [F.lit(0)]
    flat = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("r"), *(c.alias(k) for c, k in zip(given, keys)), *(F.col(o).alias(p) for o, p in zip(order, places)), value.alias("v"))

    def shown(df: DataFrame, *results: Column) -> DataFrame:
        return df.select("r.*", *(c.alias(n) for c, n in zip(results, names)))

    def local(df: DataFrame, by: list[str]) -> DataFrame:
        return df.withColumns(dict(zip("bt", running(Window.partitionBy(*by), places))))

    large = large_groups(flat, keys)
    if large is None:
        return shown(local(flat, keys), F.col("b"), F.col("t"))
    large = F.broadcast(marked(written(large), keys, "l"))  # at most 1 / SHARE rows
    hit = same(keys, "l")
    ranged = flat.join(large, hit, "left_semi").repartitionByRange(*keys, *places)
    ranged = written(ranged.withColumn("part", F.spark_partition_id()))
    # A range holds at most one group that began before it, so there are at most as many sums as ranges and large groups.
    sums = ranged.groupBy(*keys, "part").agg(summary("v", F.struct(*places)).alias("s"))
    whole = Window.partitionBy(*keys)
    carries = sums.withColumns(dict(zip(("carry", "all"), joined.over("s", whole, whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))))).drop("s")
    found = local(ranged, ["part", *keys]).join(F.broadcast(marked(carries, ["part", *keys], "c")), same(["part", *keys], "c"))
    small = flat.join(large, hit, "left_anti")
    return shown(local(small, keys), F.col("b"), F.col("t")).unionByName(shown(found, *joined.results()))


class _Sums:
    """Carries are added."""

    @staticmethod
    def over(s: str, whole: Window, before: Window) -> tuple[Column, Column]:
        return F.coalesce(F.sum(s).over(before), F.lit(0)), F.sum(s).over(whole)

    @staticmethod
    def results() -> tuple[Column, Column]:
        return F.col("b") + F.col("carry"), F.col("all")


class _Latest:
    """Carries fill in where a range has nothing yet."""

    @staticmethod
    def over(s: str, whole: Window, before: Window) -> tuple[Column, Column]:
        carry = F.last(s, True).over(before)
        return carry, carry

    @staticmethod
    def results() -> tuple[Column, Column]:
        return F.coalesce("b", "carry"), F.col("carry")


def scan(rows: DataFrame, group: list[str], order: list[str], value: Column | int = 1, before: str = "before", total: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the group that come before, and over all of its rows as ``total``.

    Without a group all rows are one. Null is a group like others and comes first in order; a null value adds 0. The order
    should tell rows apart: rows that tie are summed in any order, and stay together in one range. Columns may have any names
    but those two. An empty table gives no rows.
    """
    value = F.coalesce(value if isinstance(value, Column) else F.lit(value), F.lit(0))

    def running(window: Window, places: list[str]) -> list[Column]:
        sums = F.coalesce(F.sum("v").over(window.orderBy(*places).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return [sums, F.sum("v").over(window) if total else F.lit(None)]

    return _carried(rows, group, order, value, running, lambda v, _: F.sum(v), _Sums, [before, *([total] if total else [])])


def latest(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str = "latest", own: bool = True) -> DataFrame:
    """``rows`` with the last ``value`` of the group that isn't null, up to the row itself, or before it if not ``own``; else null.

    Groups and order are those of ``scan``.
    """

    def running(window: Window, places: list[str]) -> list[Column]:
        return [F.last("v", True).over(window.orderBy(*places).rowsBetween(Window.unboundedPreceding, 0 if own else -1)), F.lit(None)]

    known = lambda v, place: F.max_by(v, F.when(F.col(v).isNotNull(), place))
    return _carried(rows, group, order, value, running, known, _Latest, [name])
