"""Predicates and small summaries of requests: bypasses, fast-path gates, image logs, rounds, affinity, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.selection import order_statistics


def bypass_reason(images: Column, least: int = 2) -> Column:
    """Why a request isn't prepared, null where it is."""
    return F.when(images == 0, "no_images_captured").when(images < least, "image_count_below_min")


def dummy_allowed(index: Column, least: int = 2) -> Column:
    return index + 1 >= least


def image_only(counts: Column) -> Column:
    """Whether images are the one modality with a count above 0, in a map of counts."""
    some = F.map_keys(F.map_filter(counts, lambda _, n: n > 0))
    return F.coalesce(some == F.array(F.lit("image")), F.lit(False))


def fast_path(items: DataFrame, group: str, planned: Column, grid: Column) -> DataFrame:
    """(group, gate): whether all images of a request are planned and have a grid."""
    g = items.groupBy(group).agg(F.count("*").alias("n"), F.count_if(planned).alias("planned"), F.count(grid).alias("grids"))
    gate = F.when(F.col("planned") != F.col("n"), "planned_item_count_mismatch").when(F.col("grids") < F.col("n"), "missing_image_grid_thw")
    return g.select(group, gate.otherwise("synthetic_qwen_image_path").alias("gate"))


def unprepared(captured: DataFrame, prepared: DataFrame, keys: list[str]) -> DataFrame:
    return captured.select(*keys).join(prepared.select(*keys), keys, "left_anti")


def captured_count(first: DataFrame, second: DataFrame, group: str, index: str) -> DataFrame:
    """Distinct image indexes of a request over two logs."""
    both = first.select(group, index).unionByName(second.select(group, index)).distinct()
    return both.groupBy(group).agg(F.count(index).alias("images"))


def index_union(first: DataFrame, second: DataFrame, group: str, index: str) -> DataFrame:
    """Sorted indexes of a request over two logs."""
    both = first.select(group, index).unionByName(second.select(group, index)).where(F.col(index).isNotNull()).distinct()
    return both.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(index)), ",").alias("indexes"))


def round_result(completions: DataFrame, rounds: DataFrame, key: str, started: str, at: str) -> DataFrame:
    """First and last completion of each round since its start; a round without any is an error."""
    ends = completions.groupBy(key).agg(F.min(at).alias("_a"), F.max(at).alias("_z"), F.count("*").alias("items"))
    rows = rounds.join(ends, key, "left")
    return rows.select(
        key, (F.col("_a") - F.col(started)).alias("first_item_ready"), (F.col("_z") - F.col(started)).alias("all_items_ready"),
        F.coalesce("items", F.lit(0)).alias("items"), F.when(F.col("items").isNull(), "no worker completions").alias("error"),
    )


def affinity(workers: DataFrame, group: str, cpu: str) -> DataFrame:
    """Bound workers, whether all are, and whether each has a CPU of its own."""
    return workers.groupBy(group).agg(
        F.count("*").alias("workers"), F.count(cpu).alias("bound"), (F.count(cpu) == F.count("*")).alias("all_bound"), (F.countDistinct(cpu) == F.count("*")).alias("independent")
    )


def latencies(rows: DataFrame, sent: str, first: str, last: str, tokens: str) -> DataFrame:
    """``rows`` with ttft_ms, tpot_ms and e2e_ms."""
    generating = F.greatest(F.col(last) - F.col(first), F.lit(0))
    return rows.withColumns({"ttft_ms": F.col(first) - F.col(sent), "tpot_ms": generating / F.greatest(F.col(tokens) - 1, F.lit(1)), "e2e_ms": F.col(last) - F.col(sent)})


def benchmark_matrix(rows: DataFrame, keys: list[str], warmup: int) -> DataFrame:
    """Of ``rows(run, status, semantic, ttft, e2e)``: measured runs, successes, right answers, and latencies of successes, without the first runs."""
    ok = F.col("status") == 200
    of = lambda f, c: f(F.when(ok, F.col(c)))
    return rows.where(F.col("run") >= warmup).groupBy(*keys).agg(
        F.count("*").alias("measured"), F.count_if(ok).alias("ok"), F.count_if(ok & F.col("semantic")).alias("semantic_ok"),
        *(F.round(of(F.avg, c), 6).alias(f"{c}_avg") for c in ("ttft", "e2e")), *(of(F.max, c).alias(f"{c}_max") for c in ("ttft", "e2e")),
    )


def split_cost(rows: DataFrame, group: str, cost: str) -> DataFrame:
    """``rows`` with ``share``: a call's cost split evenly over its rows. Groups are counted first, so none has to fit a task."""
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    return rows.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).withColumn("share", F.col(cost) / F.col("_n")).drop("_g", "_n")


def percentile(rows: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles by linear interpolation on rank (n - 1) p, exact; a group may have any size. Nulls aren't values, null is a group."""
    flat = rows.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null")
    sizes = flat.groupBy("g").agg(F.count("*").alias("n"))
    at = {name: (F.col("n") - 1) * F.lit(p) for name, p in points.items()}
    above = lambda x: F.least(F.floor(x) + 1, F.col("n") - 1)
    ranks = sizes.select("g", F.explode(F.array_distinct(F.array(*(r for x in at.values() for r in (F.floor(x), above(x)))))).alias("rank"))
    found = order_statistics(flat, ranks).withColumnsRenamed({"g": "_g"})
    each = sizes.join(found, F.col("g").eqNullSafe(F.col("_g")))
    pick = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("v")))
    sides = each.groupBy("g", "n").agg(*(pick(r).alias(f"{side}_{name}") for name, x in at.items() for side, r in (("a", F.floor(x)), ("z", above(x)))))
    out = (F.col(f"a_{name}") + (F.col(f"z_{name}") - F.col(f"a_{name}")) * (x - F.floor(x)) for name, x in at.items())
    return sides.select(F.col("g").alias(group), *(c.alias(name) for c, name in zip(out, at)))


def argument_errors(images: Column, width: Column, height: Column, quality: Column) -> Column:
    """What is wrong with a dataset's arguments, null where nothing is."""
    return F.when(images < 1, "image count must be positive").when((width < 1) | (height < 1), "image size must be positive").when(~quality.between(1, 95), "quality must be from 1 to 95")


def barrier(rows: DataFrame, group: str, rank: str, ready: str) -> DataFrame:
    """Whether every rank of a group has reported ready, and how many reports there are."""
    ranks = rows.groupBy(group, rank).agg(F.count_if(ready).alias("_n"))
    return ranks.groupBy(group).agg(F.sum("_n").alias("n_ready"), F.count(rank).alias("world_size"), (F.count_if((F.col("_n") > 0) & F.col(rank).isNotNull()) == F.count(rank)).alias("all_ready"))
