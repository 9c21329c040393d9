"""Texts of an exact token count: pieces chosen so that their counts sum to a target."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.segments import scan


def counts_for(target: int, sizes: list[tuple[int, int]]) -> list[int] | None:
    """How many pieces of each size, of ``sizes`` (size, how many there are), largest first, sum to the target; None if none do.

    Of the ways there are it is that with the most of the largest size, then of the next. Sums that can be reached are bits of an
    integer, kept for each size, so the way is read off from the largest size on.
    """
    if target < 0:
        return None
    mask = (1 << (target + 1)) - 1
    reach = [1]  # by how many of the smallest sizes are in
    for size, n in reversed(sizes):
        bits, step = reach[-1], 1
        left = min(n, target // size)
        while left:  # 1, 2, 4, ... and the rest of the pieces at a time
            take = min(step, left)
            bits |= (bits << (size * take)) & mask
            left, step = left - take, step * 2
        reach.append(bits)
    if not reach[-1] >> target & 1:
        return None
    out = []
    for i, (size, n) in enumerate(sizes):
        rest = reach[len(sizes) - 1 - i]
        c = next(c for c in range(min(n, target // size), -1, -1) if rest >> (target - c * size) & 1)
        out.append(c)
        target -= c * size
    return out


def fit_exact(pieces: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grp, target, possible) for each of ``targets(grp, target)``, and the chosen of ``pieces(grp, pos, tokens)``.

    Of pieces of one size the first by pos are chosen; pieces without tokens never are. A target of 0 is met by none, a null or
    negative one can't be met. A null group is one like others; a group's target stands once, its pos should tell pieces apart.
    A task gets a row for each size up to the target of a group, not its pieces.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))  # noqa: E731  joins find the null group too
    asked = targets.select(name("grp").alias("g"), "grp", F.col("target").cast("int").alias("target"))
    pieces = pieces.select(F.struct(*(F.col(f"`{c}`") for c in pieces.columns)).alias("row"), name("grp").alias("g"), "pos", "tokens")
    useful = pieces.where("tokens > 0").groupBy("g", "tokens").agg(F.count("*").alias("n")).join(asked.select("g", "target"), "g").where("tokens <= target")
    rows = asked.join(useful.select("g", F.col("tokens").cast("int").alias("tokens"), F.least("n", F.col("target").cast("long")).cast("int").alias("n")), "g", "left")
    schema = pa.schema([("g", pa.string()), ("tokens", pa.int32()), ("take", pa.int32()), ("possible", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        target = table.column("target")[0].as_py()
        sizes = sorted(((t, n) for t, n in zip(table.column("tokens").to_pylist(), table.column("n").to_pylist()) if t is not None), reverse=True)
        counts = None if target is None else counts_for(target, sizes)
        taken = [(s, c) for (s, _), c in zip(sizes, counts or []) if c]
        made = [(table.column("g")[0].as_py(), s, c, True) for s, c in taken] or [(table.column("g")[0].as_py(), None, None, counts is not None)]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), schema.types)], schema=schema)

    # The choice is small beside the pieces, which are numbered by size and joined to it.
    chosen = rows.groupBy("g").applyInArrow(run, "g string, tokens int, take int, possible boolean")
    told = asked.join(chosen.groupBy("g").agg(F.max("possible").alias("possible")), "g").select("grp", "target", "possible")
    numbered = scan(pieces, ["g", "tokens"], ["pos"], before="_rank")
    taken = chosen.where("take > 0").select("g", F.col("tokens").alias("_tokens"), "take").withColumnRenamed("g", "_g")
    picked = numbered.join(taken, (F.col("g") == F.col("_g")) & (F.col("tokens") == F.col("_tokens")) & (F.col("_rank") < F.col("take")), "left_semi")
    return told, picked.select("row.*")
