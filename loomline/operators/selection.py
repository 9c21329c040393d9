"""Exact order statistics of groups of any size, without sorting them.

Groups that a task can sort go through a window over their distinct values. For the few beyond that, each round sketches the
quantiles of what is still in question, counts exactly how many values lie below, at and between the two pivots around each
rank, and keeps the open interval that holds it. Sketches only choose pivots, so their error costs rounds, not results.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators import segments
from loomline.operators.segments import marked, same
from loomline.tables import written

#: Quantiles that a sketch is asked for, its accuracy, and the rounds after which what is left is laid over ranges.
PIVOTS, ACCURACY, ROUNDS = 200, 4000, 20
_SPAN = ["g", "low", "high"]


def _exact(values: DataFrame, keys: list[str], asked: DataFrame, bounded: bool = True) -> DataFrame:
    """(g, rank, v): the r-th of ``values(keys, v)`` for each of ``asked(keys, rank, r)``; ``bounded`` if the values of any keys fit a task."""
    counts = values.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    if bounded:
        before = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    else:
        counts = segments.scan(counts, keys, ["v"], F.col("c"))
    hit = same(keys, "_") & (F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("c"))
    return asked.join(marked(counts, keys, "_"), hit).select("g", "rank", "v")


def _within(low: str, high: str) -> Column:
    return (F.col(low).isNull() | (F.col("v") > F.col(low))) & (F.col(high).isNull() | (F.col("v") < F.col(high)))


def _narrowed(held: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with where its r-th value lies, and the interval and place to look there, from values ``held(g, low, high, v)``."""
    grid = F.array(*(F.lit(i / PIVOTS) for i in range(PIVOTS + 1)))
    sketch = held.groupBy(*_SPAN).agg(F.count("*").alias("n"), F.percentile_approx("v", grid, ACCURACY).alias("q"))
    rows = marked(asked, _SPAN, "_").join(sketch, same(_SPAN, "_"))
    place = F.floor(F.col("r") * PIVOTS / F.col("n")).cast("int")
    pick = lambda at: F.when((at >= 0) & (at <= PIVOTS), F.get("q", at))
    rows = rows.select(*_SPAN, "rank", "r", pick(place - 1).alias("a"), pick(place + 2).alias("z"))
    # Sketches hold doubles, so a pivot of long integers may lie outside; it is none then.
    rows = rows.withColumn("a", F.when(F.col("low").isNull() | (F.col("a") > F.col("low")), F.col("a")))
    rows = written(rows.withColumn("z", F.when((F.col("high").isNull() | (F.col("z") < F.col("high"))) & (F.col("a").isNull() | (F.col("z") > F.col("a"))), F.col("z"))))
    pivots = marked(rows.select(*_SPAN, "a", "z").distinct(), [*_SPAN, "a", "z"], "p")  # at most one a rank
    v, a, z = F.col("v"), F.col("pa"), F.col("pz")
    told = held.join(F.broadcast(pivots), same(_SPAN, "p")).groupBy("pg", "plow", "phigh", "pa", "pz").agg(
        F.count_if(v < a).alias("below"), F.count_if(v == a).alias("at_a"), F.count_if(_within("pa", "pz")).alias("inside"), F.count_if(v == z).alias("at_z")
    )
    rows = rows.join(told, same([*_SPAN, "a", "z"], "p"))
    a, z, r = F.col("a"), F.col("z"), F.col("r")
    from_inside = F.col("below") + F.col("at_a")
    from_z = from_inside + F.col("inside")
    where = F.when(r < F.col("below"), "left").when(r < from_inside, "a").when(r < from_z, "inside").when(r < from_z + F.col("at_z"), "z").when(z.isNotNull(), "right")
    rows = rows.withColumn("where", where)
    at = lambda left, inside, right: F.when(F.col("where") == "left", left).when(F.col("where") == "inside", inside).when(F.col("where") == "right", right)
    low, high = F.col("low"), F.col("high")
    return rows.select(
        "g", "rank", "where", F.when(F.col("where") == "a", a).when(F.col("where") == "z", z).alias("v"),
        at(r, r - from_inside, r - from_z - F.col("at_z")).alias("r"), at(low, F.coalesce(a, low), z).alias("low"), at(a, F.coalesce(z, high), high).alias("high"),
    )


def _select(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(g, rank, v) for a bounded number of groups, each of any number of ``values(g, v)``."""
    none = F.lit(None).cast(dict(values.dtypes)["v"])
    # The rank-th value of g is the r-th of those between low and high.
    asked = written(ranks.withColumns({"r": F.col("rank"), "low": none, "high": none}))
    found, before = [], None
    for number in count():
        spans = F.broadcast(marked(written(asked.select(*_SPAN).distinct()), _SPAN, "s"))  # at most one a rank
        near = same(["g"], "s") & _within("slow", "shigh")
        if number:
            values = written(values.join(spans, near, "left_semi"))
        held = values.join(spans, near).select("g", F.col("slow").alias("low"), F.col("shigh").alias("high"), "v")
        most = held.groupBy(*_SPAN).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0 if number else None
        # Pivots that no longer narrow, as of long integers that are one double, leave the rest to ranges.
        if number and (most <= segments.LEAST or number == ROUNDS or most == before):
            found.append(_exact(held, _SPAN, asked, most <= segments.LEAST))
            break
        before = most
        met = written(_narrowed(held, asked))
        found.append(met.where("where in ('a', 'z')").select("g", "rank", "v"))
        asked = met.where("where in ('left', 'inside', 'right')").select("g", "rank", "r", "low", "high")
        if asked.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def order_statistics(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(g, rank, v): the rank-th smallest, from 0, of ``values(g, v)`` for each of ``ranks(g, rank)``; nulls aren't values.

    A null g is a group of its own, NaN is above all numbers. A rank that a group doesn't reach gives no row.
    """
    values = values.where(F.col("v").isNotNull())
    large = segments.large_groups(values, ["g"])
    asked = ranks.withColumn("r", F.col("rank"))
    if large is None:
        return _exact(values, ["g"], asked)
    large = F.broadcast(marked(written(large), ["g"], "l"))  # at most 1 / SHARE rows
    split = lambda rows, how: rows.join(large, same(["g"], "l"), how)
    chosen = _select(split(values, "left_semi"), split(ranks, "left_semi"))
    return _exact(split(values, "left_anti"), ["g"], split(asked, "left_anti")).unionByName(chosen)
