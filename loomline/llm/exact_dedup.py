"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of BLOCK bytes. The distinct blocks get integer names by sorting, so two
blocks share a name only if their bytes are equal. Adjacent names are then paired and the distinct
pairs named likewise, level by level, until every document has one name: two documents of one
number of levels have equal names only if their texts are equal byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import COMMON, SHARE, hot_join, let, save

#: Bytes of a block.
BLOCK = 4096
#: Hash ranges in which blocks or pairs are sorted: names carry the range above RANK_BITS bits.
RANGES, RANK_BITS = 4096, 44

def _named(rows: DataFrame, keys: list[str], name: str, total: int) -> DataFrame:
    """``rows`` with an integer in place of ``keys``: one for each distinct value, equal for equal values only.

    Rows go to hash ranges, are sorted there, and the rank is the name: one shuffle. Common values
    are found by counting hashes; those of more than a share of the ``total`` rows are a bounded number. Their rows stay out of that shuffle:
    their distinct values, combined in each task first, are ranked alone and joined back.
    """
    rows = rows.withColumn("_h", F.xxhash64(*keys))
    common = rows.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") > max(COMMON, int(total * SHARE)))
    rows = rows.join(F.broadcast(common.select("_h", F.lit(True).alias("_common"))), "_h", "left")  # some 1 / SHARE hashes
    rest = [c for c in rows.columns if c not in (*keys, "_h", "_common")]
    spread = F.pmod(F.col("_h"), F.lit(RANGES))
    rank = F.dense_rank().over(Window.partitionBy("_range").orderBy(*keys)).cast("long")
    number = F.shiftleft(F.col("_range"), RANK_BITS) + rank
    few = rows.where("_common is null").withColumn("_range", spread).select(*rest, number.alias(name))
    many = rows.where("_common")
    names = many.select(*keys, "_h").distinct().withColumn("_range", spread + RANGES).select(*keys, number.alias(name))
    same: Column = F.lit(True)
    # At most 1 / SHARE names of BLOCK bytes; unbroadcast, the rows of one common value would meet in one task.
    left, right = many.alias("l"), F.broadcast(names).alias("r")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return few.unionByName(left.join(right, same).select(*[F.col(f"l.{c}") for c in rest], f"r.{name}"))


def _row() -> Column:
    """What a row's blocks are put together by, beside its doc_id: a digest that no two texts share, while names decide which texts are equal."""
    return F.unhex(F.sha2("raw", 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared unchanged; null counts as the empty text. Of equal texts the largest doc_id
    stays (a null id loses to any other). Rows that repeat a doc_id with the same text are marked
    alike. An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    row = F.struct(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = docs.select(row.alias("d")).select(F.col("d.i").alias("doc_id"), F.col("d.t").cast("binary").alias("raw"))
    size = F.octet_length("raw")
    n_blocks = F.greatest(F.lit(1), F.ceil(size / BLOCK).cast("int"))
    cut = let(F.col("raw"), lambda raw: F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.substring(raw, i * BLOCK + 1, F.lit(BLOCK))))
    blocks = base.select("doc_id", _row().alias("row_hash"), n_blocks.alias("n"), F.posexplode(cut).alias("pos", "block"))
    first = base.agg(F.count("*").alias("docs"), F.sum(n_blocks.cast("long")).alias("blocks")).first()
    total = first["blocks"] or 0
    level = save(_named(blocks, ["block"], "name", total))
    done, depth = [], 0
    while True:
        done.append(level.where("n = 1").select("doc_id", "row_hash", F.lit(depth).alias("depth"), "name"))
        level = level.where("n > 1")
        total = level.count()
        if not total:
            break
        # Rows that repeat both the id and the text are one here, and their pairs have sides of one value.
        at = F.floor(F.col("pos") / 2).cast("int")
        even, odd = F.col("pos") % 2 == 0, F.col("pos") % 2 == 1
        pairs = level.groupBy("doc_id", "row_hash", "n", at.alias("pos")).agg(
            F.min(F.when(even, F.col("name"))).alias("first"), F.min(F.when(odd, F.col("name"))).alias("second")
        )
        pairs = pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int"))
        level, depth = save(_named(pairs, ["first", "second"], "name", total)), depth + 1
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    groups = names.distinct()
    rows = base.select("doc_id", _row().alias("row_hash"), F.sha2("raw", 256).alias("text_sha256"))
    left, right = rows.alias("l"), groups.alias("r")
    named = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.row_hash") == F.col("r.row_hash")))
    named = save(named.select("l.doc_id", "l.text_sha256", F.struct("r.depth", "r.name").alias("name")))
    sizes = save(named.groupBy("name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = hot_join(named, sizes, "name", "group_size", first["docs"])
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
