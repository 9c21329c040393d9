"""Mixing sources to target weights, in DataFrame operations.

A source's rate is its target over its size. A document is emitted floor(rate) times, plus once
more if a hash of its id under the source's seed falls below the fraction. Each source takes, of
SEEDS fixed seeds, the one under which its total comes closest to its target; the totals of all
seeds come from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, save

#: Weights that the sources take in turn, sorted by code point with null last.
WEIGHTS = (5, 2, 1)
#: Most copies of a document, as targets stop at this many times a source's size.
MOST = 3
SEEDS = 32
#: Draws have BITS bits; each seed turns them by STEP, the golden section of their range.
BITS, STEP = 40, 679_539_536_917
#: Sources whose table is broadcast; more are joined by a shuffle.
MOST_BROADCAST = 10_000


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sources(source, source_size)`` with target: shares of the whole by weight, none above most x size.

    With cap/weight as each source's ceiling, capping the sources in order of their ceilings raises the
    level that the others share until the next ceiling is above it, so the highest level is the one
    sought; sorted ceilings make that one running sum.
    The windows run over one row per source, in one task.
    """
    last = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(last) - 1, F.lit(len(weights))) + 1
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("ceiling", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ceiling", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_w", F.sum("weight").over(every))
    rows = rows.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("w_left", F.col("all_w") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.col("total") - F.col("used")) / F.col("w_left")
    rows = rows.withColumn("level", F.max(level).over(every))
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def _draw(seed: Column) -> Column:
    """A number in [0, 1) from the document's id and size, turned by a seed."""
    spelled = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    bits = F.conv(F.substring(F.md5(spelled), 1, BITS // 4), 16, 10).cast("long")
    return F.pmod(bits + seed * STEP, F.lit(1 << BITS)) / F.lit(float(1 << BITS))


def _with(rows: DataFrame, sources: DataFrame, *columns: str) -> DataFrame:
    """Inner join of ``rows`` (l) with a saved table of one row a source (r)."""
    table = F.broadcast(sources) if sources.count() <= MOST_BROADCAST else sources
    return rows.alias("l").join(table.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", *(f"r.{c}" for c in columns))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def rates(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The saved table (source, source_size, target, rate, seed) for ``sized(doc_id, source, size)``."""
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = save(goal.withColumn("rate", rate))
    part = F.col("rate") - F.floor(F.col("rate"))
    extra = lambda seed: F.sum(F.when(_draw(F.lit(seed)) < part, F.col("size")).otherwise(0))
    sums = _with(sized, goal, "rate").groupBy("source").agg(F.array(*map(extra, range(SEEDS))).alias("extra"))
    off = lambda x: F.abs(x + F.floor(F.col("l.rate")) * F.col("l.source_size") - F.col("l.target"))
    tries = F.transform("r.extra", lambda x, seed: F.struct(off(x).alias("off"), seed.alias("seed")))
    best = goal.alias("l").join(sums.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")))
    return save(best.select("l.*", F.array_min(tries)["seed"].alias("seed")))


def _copies() -> Column:
    whole = F.floor(F.col("rate"))
    return (whole + (_draw(F.col("seed")) < F.col("rate") - whole).cast("long")).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, copies, taken (copies x size).

    Size is the number of words of the whole text (null: 0). An empty source string is a source of
    its own, null sorts last. A source of size 0 has target 0 and gives no copies. Rows that repeat
    a doc_id draw alike. An empty table gives no rows; other columns are ignored.
    """
    sized = save(docs.select("doc_id", "source", _size()))
    out = _with(sized, rates(sized, weights, most), "source_size", "target", "rate", "seed")
    return out.select("doc_id", "size", "source", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def emit(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Texts aren't shuffled where the sources' table is small."""
    plan = rates(save(docs.select("doc_id", "source", _size())), weights, most)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = docs.select(row, "doc_id", "source", _size())
    rows = _with(rows, plan, "rate", "seed").select("row", "doc_id", "size", "rate", "seed")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int")))).select("row.*")
