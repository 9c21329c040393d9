"""Merkle manifest of a dataset: digests of rows, roots of groups and of the whole, and a proof for every row.

The rows of a group stand in order; every FAN consecutive nodes (the last run has fewer, even one) become one node until one
remains. Aligned blocks of BLOCK nodes are traversed by a task each: in postorder a call returns its subtree's digest and,
while it unwinds, appends the siblings of each child to the leaves under it. The roots of blocks are the nodes of the next
distributed traversal, and the roots of groups those of a last tree. A row's proof is what its block, the blocks above and
the tree of groups have appended.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.segments import scan

from .common import discard, hot_join, save

#: Children of a node, and levels that one task traverses at a time.
FAN, LEVELS = 8, 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*values: Column) -> Column:
    """Hex SHA-256 of the values: each its count of UTF-8 bytes, a colon and itself, or a dash where it is null."""
    texts = [v.cast("string") for v in values]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*told), 256)


def traverse(nodes: list[str], levels: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest of the tree of so many levels over the nodes; by node, the siblings to its left and right in each run on its way up."""
    steps: list[list[tuple[str, str]]] = [[] for _ in nodes]

    def climb(low: int, levels: int) -> str:
        if not levels:
            return nodes[low]
        width = FAN ** (levels - 1)
        starts = range(low, min(low + FAN * width, len(nodes)), width)
        children = [climb(at, levels - 1) for at in starts]
        for k, at in enumerate(starts):
            beside = "".join(children[:k]), "".join(children[k + 1 :])
            for leaf in steps[at : at + width]:
                leaf.append(beside)
        return hashlib.sha256("".join(children).encode()).hexdigest()

    return climb(0, levels), steps


def levels_of(n: int) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


_STEPS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def _climbed(nodes: DataFrame) -> DataFrame:
    """``nodes(key, at, n, digest, ...)`` with ``steps`` and the ``top`` digest of their block of FAN ** LEVELS places."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n = table.column("n")[0].as_py()
        top, steps = traverse(table.column("digest").to_pylist(), min(LEVELS, levels_of(n)))
        ends = [0]
        for s in steps:
            ends.append(ends[-1] + len(s))
        sides = [pa.array([pair[side] for s in steps for pair in s], pa.string()) for side in (0, 1)]
        proofs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, ["left", "right"]))
        return table.append_column("steps", proofs).append_column("top", pa.array([top] * len(steps)))

    blocks = nodes.withColumn("block", F.floor(F.col("at") / FAN**LEVELS))
    schema = T.StructType([*blocks.schema, T.StructField("steps", _STEPS), T.StructField("top", T.StringType())])
    return blocks.groupBy("key", "block").applyInArrow(run, schema)


def _tree(nodes: DataFrame) -> DataFrame:
    """``nodes(key, at, n, digest, ...)``, n nodes of each key at 0 to n - 1, with their whole ``steps`` and the ``root`` of the key."""
    own = save(_climbed(nodes))
    if (own.agg(F.max("n")).first()[0] or 0) <= FAN**LEVELS:
        return own.drop("block").withColumnRenamed("top", "root")
    n = F.ceil(F.col("n") / FAN**LEVELS)
    upper = _tree(own.where(F.col("at") % FAN**LEVELS == 0).select("key", F.col("block").alias("at"), n.alias("n"), F.col("top").alias("digest")))
    above = upper.select("key", F.col("at").alias("block"), F.col("steps").alias("more"), "root")
    joined = own.join(above.hint("merge"), ["key", "block"])  # a block has at most FAN ** LEVELS rows
    return joined.withColumn("steps", F.concat("steps", "more")).drop("block", "more", "top")


def grow(rows: DataFrame, group: str, order: str, leaf: str) -> DataFrame:
    """``rows`` with ``subroot``, ``root`` and ``proof``, an array of the siblings' digests ``left`` and ``right`` of the row, level by level.

    ``leaf`` is a column of hex digests. Rows of a group stand by ``order`` (null first), then by leaf; repeated rows are
    leaves of their own. Groups stand in order, null first as a group of its own. An empty table gives no rows.
    """
    table = save(rows.select(
        F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("r"), F.col(group).alias("g"), F.col(order).alias("o"), F.col(leaf).alias("digest"),
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("key"),
    ))
    # Rows that are equal in all columns differ in their places in the table, so that they needn't meet in one task.
    placed = scan(table.withColumn("tie", F.monotonically_increasing_id()), ["key"], ["o", "digest", "tie"], before="at", total="n")
    leaves = _tree(placed.drop("o", "tie"))
    tops = save(leaves.where("at = 0").select("key", "g", F.col("n").alias("copies"), F.col("root").alias("digest")))
    ordered = scan(tops, [], ["g"], before="at", total="n").withColumnsRenamed({"key": "name"}).withColumn("key", F.lit(""))
    groups = _tree(ordered).select(F.col("name").alias("key"), "copies", F.col("steps").alias("more"), F.col("root").alias("whole"))
    discard(table)
    total = tops.agg(F.sum("copies")).first()[0] or 0
    out = hot_join(leaves.select("r", "key", "steps", "root"), save(groups), "key", "copies", total)
    return out.select("r.*", F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("steps", "more").alias("proof"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to by its proof."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Hex SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(docs: DataFrame, *more: Column) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, leaf, further columns of digests, subroot, root and proof.

    A leaf is the digest of FIELDS, nulls told from empty values; further columns of ``docs`` are ignored. Groups are the
    values of lang, whose rows stand by doc_id. Any text is hashed whole.
    """
    leaf = digest(*(F.col(c) for c in FIELDS)).alias("leaf")
    return grow(docs.select("doc_id", "lang", leaf, *more), "lang", "doc_id", "leaf")


#: The letters that tampering changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_leaf() -> Column:
    """The leaf of a row whose text has lost its capitals A-Z if 3 divides the CRC-32 of its decimal doc_id; else its own."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return digest(*(text if c == "text" else F.col(c) for c in FIELDS))


def verify_tampered(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: the manifest of ``docs`` held against tampered rows.

    A null doc_id isn't tampered with; a null text stays null.
    """
    rows = manifest(docs, tampered_leaf().alias("tampered"))
    folded = fold(F.col("tampered"), F.col("proof"))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
