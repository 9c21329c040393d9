import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import features, relational, segments


def brute(rows, size):
    """before and total of (g, o, v, id) rows."""
    out, sums = {}, {}
    for g, o, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        out[i] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)
    return {i: (out[i], sums[g]) for g, o, v, i in rows}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(segments, "LEAST", 50)


def table(spark, rows):
    df = spark.createDataFrame(rows, "g long, o long, v long, id long")
    for c in ("r", "part", "b", "g0", "large"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("limit", [50, 1 << 16])
def test_scan(spark, monkeypatch, apart, limit):
    monkeypatch.setattr(segments, "LEAST", limit)
    draw = random.Random(3)
    groups = [7] * 900 + [None] * 300 + [draw.randrange(100, 160) for _ in range(400)] + [8] * 51
    rows = [(g, o, draw.choice([None, 0, 1, 5]), o) for o, g in enumerate(draw.sample(groups, len(groups)))]
    df = table(spark, rows)
    got = segments.scan(df, ["g"], ["o"], F.col("v"), total="total")
    assert got.columns == [*df.columns, "before", "total"]
    assert {r["id"]: (r["before"], r["total"]) for r in got.collect()} == brute(rows, limit)
    assert got.count() == len(rows)
    assert segments.scan(df.where("id < 0"), ["g"], ["o"]).count() == 0


@pytest.mark.parametrize("limit", [50, 1 << 16])
def test_latest(spark, monkeypatch, apart, limit):
    monkeypatch.setattr(segments, "LEAST", limit)
    draw = random.Random(5)
    rows = [(draw.choice([7, 7, None, 9 + o % 50]), o, draw.choice([None] * 30 + [o]), o) for o in range(2000)]
    got = segments.latest(table(spark, rows), ["g"], ["o"], F.col("v"))
    held, want = {}, {}
    for g, o, v, i in rows:
        held[g] = want[i] = held.get(g) if v is None else v
    assert {r["id"]: r["latest"] for r in got.collect()} == want


@pytest.fixture
def apart(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_group_spreads_over_tasks(spark, small, apart):
    df = spark.range(40_000).select((F.lit(40_000) - F.col("id")).alias("o"), F.lit(2).alias("n"))
    out = relational.allocate(df, ["o"], "n")
    assert out.where("start <> (o - 1) * 2 or stop <> o * 2").count() == 0
    shares = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(shares) > 3 and max(shares) < 20_000


def test_users_of_the_scan(spark, small):
    slots = spark.range(300).select(F.lit(1).alias("g"), F.col("id").alias("pos"), (F.col("id") % 3 == 0).alias("m"))
    made = spark.range(100).select(F.lit(1).alias("g"), (F.col("id") + 1).alias("k"), (F.col("id") * 10).alias("v"))
    got = features.scatter(slots, made, "g", "pos", "m", "v", F.lit(-1).cast("long")).collect()
    assert {r["pos"]: r["merged"] for r in got} == {i: i // 3 * 10 if i % 3 == 0 else -1 for i in range(300)}
    assert {r["error"] for r in features.scatter(slots, made.where("k < 9"), "g", "pos", "m", "v", F.lit(0).cast("long")).collect()} == {"embedding count mismatch"}
    items = spark.range(120).select(F.lit(1).alias("g"), F.col("id").alias("idx"), F.lit(0).alias("rank"), (F.lit(120) - F.col("id")).alias("place"), (F.col("id") % 2 + 1).alias("rows"))
    blocks = spark.range(180).select(F.lit(1).alias("g"), F.lit(0).alias("rank"), F.col("id").alias("row"), F.col("id").alias("value"))
    got = {(r["idx"], r["i"]): r["value"] for r in features.gathered(blocks, items, "g").collect()}
    want, at = {}, 0
    for idx in reversed(range(120)):
        for i in range(idx % 2 + 1):
            want[idx, i], at = at, at + 1
    assert got == want
    numbered = relational.with_index(slots, "g", ["pos"])
    assert dict(numbered.dtypes)["idx"] == "int" and numbered.where("idx <> pos").count() == 0
    assert relational.all_match(slots, "g", F.col("pos") < 299).count() == 0
    assert relational.all_match(slots, "g", F.col("pos") < 300).count() == 300
