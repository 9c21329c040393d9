import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import gates, segments, selection


def drawn(seed):
    """Hot groups of heavy ties, of all but equal, of far apart and of special values; a null group; small groups."""
    draw = random.Random(seed)
    rows = [("ties", draw.choice([1.0, 1.0, 1.0, 2.5, -3.0])) for _ in range(900)]
    rows += [("wide", draw.choice([-1, 1]) * 10.0 ** draw.uniform(-300, 300)) for _ in range(1500)]
    rows += [(None, float(draw.randrange(10**6))) for _ in range(700)] + [("odd", v) for v in [math.inf, -math.inf, -0.0, 5e-324] * 40]
    rows += [(f"g{draw.randrange(40)}", draw.gauss(0, 1)) for _ in range(400)] + [("ties", None), ("none", None)] + [("flat", 7.0)] * 500
    draw.shuffle(rows)
    return rows


def want(rows, points):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    out = {}
    for g, own in groups.items():
        own.sort()
        out[g] = []
        for p in points:
            at = (len(own) - 1) * p
            low, high = own[math.floor(at)], own[min(math.floor(at) + 1, len(own) - 1)]
            with np.errstate(all="ignore"):
                out[g].append(float(np.float64(low) + (np.float64(high) - np.float64(low)) * np.float64(at - math.floor(at))))
    return out


@pytest.mark.parametrize("least,pivots,rounds", [(50, 200, 20), (50, 4, 20), (50, 4, 2), (1 << 16, 200, 20)])
def test_percentiles_of_hot_groups(spark, monkeypatch, least, pivots, rounds):
    monkeypatch.setattr(segments, "LEAST", least)
    monkeypatch.setattr(selection, "PIVOTS", pivots)
    monkeypatch.setattr(selection, "ROUNDS", rounds)
    sizes, exact = [], selection._exact

    def spy(values, keys, asked, bounded=True):
        sizes.append((bounded, values.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0))
        return exact(values, keys, asked, bounded)

    monkeypatch.setattr(selection, "_exact", spy)
    rows, points = drawn(least), [0.0, 0.3, 0.5, 0.95, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit(1))
    got = gates.percentile(df, "g", "v", {f"p{i}": p for i, p in enumerate(points)})
    told = {r["g"]: [r[f"p{i}"] for i in range(len(points))] for r in got.collect()}
    for g, values in want(rows, points).items():
        assert np.array_equal(told.pop(g), values, equal_nan=True), g
    assert not told
    # What one task sorts is bounded, however large the group is.
    assert all(n <= least for bounded, n in sizes if bounded)
    assert gates.percentile(df.where("v > 1e305 and v < 0"), "g", "v", {"p": 0.5}).count() == 0


def test_order_statistics_of_other_types(spark, monkeypatch):
    monkeypatch.setattr(segments, "LEAST", 100)
    big = [2**62 + i for i in range(3000)]
    values = spark.createDataFrame([("a", v) for v in random.Random(2).sample(big, 3000)], "g string, v long")
    ranks = spark.createDataFrame([("a", 0), ("a", 1500), ("a", 2999), ("a", 3000), ("b", 0)], "g string, rank long")
    assert {r["rank"]: r["v"] for r in selection.order_statistics(values, ranks).collect()} == {k: big[k] for k in (0, 1500, 2999)}
    days = values.select("g", F.date_add(F.lit("2020-01-01"), (F.col("v") % 1000).cast("int")).alias("v"))
    ordered = sorted(r["v"] for r in days.collect())
    assert {r["rank"]: r["v"] for r in selection.order_statistics(days, ranks).collect()} == {k: ordered[k] for k in (0, 1500, 2999)}
