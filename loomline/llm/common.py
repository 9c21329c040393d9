"""Helpers shared by the training-data operators: durable intermediate tables, words, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage are maximal runs of characters other than the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of text that the Python operators hold as word lists at a time; one longer text is a slice of its own.
SLICE, SLICE_BYTES = 256, 4 << 20
#: A value is common with more rows than COMMON and than a SHARE of all; so there are at most 1 / SHARE common values.
COMMON, SHARE = 1000, 1e-4


def slices(batch: pa.RecordBatch, column: int, rows: int = SLICE, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices bounded by rows and by the bytes of one column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[at] - sizes[at] + most, side="right"))
        stop = max(at + 1, min(stop, at + rows))
        yield batch.slice(at, stop - at)
        at = stop


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made up only for local masters."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", path := tempfile.mkdtemp(prefix="loomline-"))
    return path


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back, which cuts its lineage.

    The files survive lost executors and go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``save`` gave and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._saved_at)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def hot_join(rows: DataFrame, table: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which holds each key once with the number of rows that have it.

    Keys of more than max(COMMON, SHARE x total) rows are at most 1 / SHARE and are broadcast, so no
    task gets all rows of one; the others are joined by a shuffle. ``table`` is read twice.
    """
    limit = max(COMMON, int(total * SHARE))
    hot = table.where(F.col(copies) > limit)
    found = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")  # at most 1 / SHARE rows
    cold = table.where(F.col(copies) <= limit)
    rest = found.where("_hot is null").select(*rows.columns).join(cold.hint("merge"), key)
    return found.where("_hot").drop("_hot").unionByName(rest)


#: The factor of a byte's place in a hash, and a random number for each byte.
_PLACE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_kept: dict[int, np.ndarray] = {}


def _powers(factor: int, n: int) -> np.ndarray:
    """The first n powers modulo 2^64; up to 2^23 of them are kept."""
    if n > len(_kept.get(factor, ())):
        out = np.full(max(n, 1 << 20), np.uint64(factor))
        out[0] = 1
        out = np.multiply.accumulate(out)
        if len(out) > 1 << 23:
            return out[:n]
        _kept[factor] = out
    return _kept[factor][:n]


#: Bytes that are hashed at a time.
_CHUNK = 1 << 19


def spelled(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings between start and stop in a buffer of bytes; equal strings have equal ones, wherever they are.

    Starts ascend; the sums are held for a chunk of the buffer at a time.
    """
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + _CHUNK)))
        low, high = int(start[at]), int(stop[at:to].max())
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        terms = _BYTES[buf[low:high]]
        terms *= _powers(_PLACE, high - low)
        np.cumsum(terms, out=sums[1:])
        a, z = start[at:to] - low, stop[at:to] - low
        out[at:to] = (sums[z] - sums[a]) * _powers(pow(_PLACE, -1, 1 << 64), high - low + 1)[a]
        at = to
    return out


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, each followed by one space, in one buffer; where each starts and stops; and their number by text."""
    raw = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]), dtype=np.uint8)
    blank = ((raw - np.uint8(9)) < 5) | (raw == 32)
    edge = np.flatnonzero(np.concatenate([[not blank[0]], blank[1:] != blank[:-1]])) if len(raw) else np.empty(0, dtype=np.int64)
    first, end = edge[0::2], edge[1::2]  # the last byte is blank
    ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts)))
    sizes = np.diff(np.searchsorted(first, ends), prepend=0)
    after = np.concatenate([[False], ~blank[:-1]]) if len(raw) else blank
    buf = np.where(blank, np.uint8(32), raw)[~blank | after]
    stop = np.cumsum(end - first + 1) - 1
    return buf, stop - (end - first), stop, sizes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once even where lambdas in the body use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every ``a`` has one ``b`` and no node is on both sides."""
    sides = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    sides = sides.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).select(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """The saved table (node, component) of connected components of ``edges(a long, b long)``; a component is its smallest node.

    Alternates large-star and small-star rewiring until every node hangs on its component's smallest one. Each step is a
    grouped minimum and a join on the grouped key, so a hub costs one row for each of its edges and
    is pre-aggregated before the shuffle; nothing is collected but a flag.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    now = save(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_star_forest(now):
        around = now.union(now.select("b", "a"))
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        spent, now = now, save(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        discard(spent)
    done = save(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()))
    discard(now)
    return done
