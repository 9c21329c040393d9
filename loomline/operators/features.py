"""Features, planned items and artifacts of requests: indexes, joins, placeholders, merges, gathering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import payloads
from loomline.operators.segments import scan


def by_index(items: DataFrame, group: str, index: str, pos: str) -> DataFrame:
    """Items by index, which defaults to the position; of equal indexes the last counts."""
    rows = items.withColumn(index, F.coalesce(F.col(index), F.col(pos).cast("int")))
    last = F.row_number().over(Window.partitionBy(group, index).orderBy(F.desc(pos)))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r")


def usable_indexes(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose index reads as an integer, with it as ``idx``."""
    return rows.withColumn("idx", F.expr(f"try_cast(trim(`{text}`) AS int)")).where("idx is not null")


def shard_split(scheduled: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """Scheduled rows with ``place``: local where this shard holds them, remote otherwise."""
    held = local.select(*keys).distinct().withColumn("_held", F.lit(True))
    return scheduled.join(held, keys, "left").withColumn("place", F.when(F.col("_held"), "local").otherwise("remote")).drop("_held")


def attach(features: DataFrame, artifacts: DataFrame, keys: list[str], data: str) -> DataFrame:
    """Features with the data of their artifacts and ``replaced``; only images take any."""
    made = artifacts.select(*keys, F.col(data).alias("_new"))
    rows = features.join(made, keys, "left")
    hit = (F.col("modality") == "image") & F.col("_new").isNotNull()
    return rows.withColumn(data, F.when(hit, F.col("_new")).otherwise(F.col(data))).withColumn("replaced", F.coalesce(hit, F.lit(False))).drop("_new")


def in_order(artifacts: DataFrame, wanted: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Artifacts of the wanted ids with their places; ids without one are missing."""
    return wanted.select(*keys, pos).join(artifacts, keys)


def resolved_grids(scheduled: DataFrame, planned: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """The grid of each scheduled image: its planned item's, else its feature's."""
    a, b = planned.select(*keys, F.col("grid").alias("_p")), features.select(*keys, F.col("grid").alias("_f"))
    rows = scheduled.join(a, keys, "left").join(b, keys, "left")
    return rows.withColumn("grid", F.coalesce("_p", "_f")).drop("_p", "_f")


def whole_batches(rows: DataFrame, group: str, *needed: str) -> DataFrame:
    """Rows of the groups in which no needed column is null; groups are judged by one aggregate, so a large one needn't fit a task."""
    broken = rows.where(" or ".join(f"`{c}` is null" for c in needed)).select(F.col(group).alias("_g")).distinct()
    return rows.join(broken, F.col(group).eqNullSafe(F.col("_g")), "left_anti")


def zipped(left: DataFrame, right: DataFrame, group: str, pos: str) -> DataFrame:
    """Rows of equal position side by side, with ``error`` on every row of a group whose sides differ in length."""
    n = left.groupBy(group).agg(F.count("*").alias("_l")).join(right.groupBy(group).agg(F.count("*").alias("_r")), group, "full")
    both = left.join(right, [group, pos], "full").join(n, group)
    bad = F.coalesce("_l", F.lit(0)) != F.coalesce("_r", F.lit(0))
    return both.withColumn("error", F.when(bad, "length mismatch")).drop("_l", "_r")


def scheduled_features(ids: DataFrame, features: DataFrame, group: str, index: str) -> DataFrame:
    """The features at the scheduled indexes; indexes out of range are passed over, and one that isn't an image leaves nothing."""
    rows = ids.select(group, index).join(features, [group, index])
    mixed = rows.where(~F.coalesce(F.col("modality") == "image", F.lit(False))).select(group).distinct()
    return rows.join(mixed, group, "left_anti")


def is_placeholder(data: Column, synthetic: Column) -> Column:
    """Whether data is missing, marked synthetic or an empty tensor."""
    return data.isNull() | F.coalesce(synthetic, F.lit(False)) | (F.size(data) == 0)


def placeholder(t: Column, gh: Column, gw: Column, width: Column, synthetic: bool) -> Column:
    """An empty tensor (synthetic), or one of zeros with a row a patch."""
    if synthetic:
        return F.array().cast("array<float>")
    return F.array_repeat(F.lit(0.0).cast("float"), (t * gh * gw * width).cast("int"))


def fill_remote(rows: DataFrame, rank: int, data: str = "data") -> DataFrame:
    """Data of images that another rank makes and that still look like placeholders become zeros."""
    remote = F.col("producer_rank").isNotNull() & (F.col("producer_rank") != rank)
    empty = is_placeholder(F.col(data), F.col("synthetic"))
    zeros = placeholder(F.col("t"), F.col("gh"), F.col("gw"), F.col("width"), False)
    return rows.withColumn("filled", remote & empty).withColumn(data, F.when(remote & empty, zeros).otherwise(F.col(data)))


def flat_rows(nested: Column) -> Column:
    """Embeddings as a list of rows; an array of numbers is one row. ``nested`` is array<array<...>> of one depth more."""
    return F.flatten(nested)


def scatter(slots: DataFrame, embeddings: DataFrame, group: str, pos: str, mask: str, value: str, fill: Column) -> DataFrame:
    """The k-th masked slot gets the k-th embedding, others ``fill``; ``error`` where a group's counts differ.

    ``embeddings(group, k, value)`` counts k from 1.
    """
    counted = scan(slots, [group], [pos], F.col(mask).cast("int"), before="k")
    numbered = counted.withColumn("k", F.when(F.col(mask), F.col("k") + 1))
    sizes = slots.groupBy(group).agg(F.count_if(mask).alias("_m")).join(embeddings.groupBy(group).agg(F.count("*").alias("_e")), group, "left")
    bad = F.col("_m") != F.coalesce("_e", F.lit(0))
    out = numbered.join(embeddings.select(group, "k", F.col(value).alias("_v")), [group, "k"], "left").join(sizes, group)
    return out.select(*slots.columns, F.when(~bad, F.when(F.col(mask), F.col("_v")).otherwise(fill)).alias("merged"), F.when(bad, "embedding count mismatch").alias("error"))


def gathered(blocks: DataFrame, items: DataFrame, group: str) -> DataFrame:
    """Rows of padded rank blocks in the items' own order. ``items(group, idx, rank, place, rows)``: the place-th item of a rank
    takes the next rows of its block; ``blocks(group, rank, row, value)``. Items with a missing row get ``error``."""
    each = scan(items, [group, "rank"], ["place"], F.col("rows"), before="_start").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows").cast("long") - 1))).withColumn("row", F.col("_start") + F.col("i"))
    out = each.join(blocks.select(group, "rank", "row", "value"), [group, "rank", "row"], "left")
    return out.select(group, "idx", "i", "value", F.when(F.col("value").isNull(), "hole in gathered rows").alias("error"))


def cursor(slices: DataFrame, context: DataFrame, group: str) -> DataFrame:
    """Whether the slice a request asks for next is what the context holds there. ``slices(group, call, grids)`` in order of call,
    ``context(group, grids)``; a call that doesn't match gets no place and doesn't advance."""
    calls = slices.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("call", "grids"))).alias("c"))
    step = """named_struct('at', CASE WHEN slice(grids, s.at + 1, size(x.grids)) = x.grids THEN s.at + size(x.grids) ELSE s.at END,
      'out', concat(s.out, array(named_struct('call', x.call, 'start', CASE WHEN slice(grids, s.at + 1, size(x.grids)) = x.grids THEN s.at END))))"""
    zero = "named_struct('at', 0, 'out', CAST(array() AS array<struct<call: bigint, start: int>>))"
    folded = calls.join(context, group).select(group, F.explode(F.expr(f"aggregate(c, {zero}, (s, x) -> {step}).out")).alias("o"))
    return folded.select(group, "o.call", "o.start")


def serialized(planned: DataFrame, descriptors: DataFrame, keys: list[str]) -> DataFrame:
    """Planned items with a descriptor as JSON, with the descriptor's transport and source key; items without one are left out."""
    rows = planned.join(descriptors.select(*keys, "transport", "source_key"), keys)
    fields = ("request_media_index", "item_identity", "transport", "source_key", "image_grid_thw", "placeholder_token_count", "processor_signature")
    return rows.select(*keys, payloads.encode(**{c: F.col(c) for c in fields}).alias("item"))
