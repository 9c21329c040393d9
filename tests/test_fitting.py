import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import fitting, segments


def brute(target, sizes):
    best = None
    for counts in itertools.product(*(range(n, -1, -1) for _, n in sizes)):
        if sum(s * c for (s, _), c in zip(sizes, counts)) == target:
            best = list(counts)  # the first in this order has the most of the largest
            break
    return best


def test_counts_against_all_ways():
    draw = random.Random(1)
    for _ in range(400):
        sizes = sorted({draw.randrange(1, 12): draw.randrange(1, 5) for _ in range(draw.randrange(0, 5))}.items(), reverse=True)
        target = draw.randrange(-1, 40)
        assert fitting.counts_for(target, sizes) == (brute(target, sizes) if target >= 0 else None)
    assert fitting.counts_for(99_999, [(10, 10**6), (3, 3)]) == [9_999, 3]


@pytest.mark.parametrize("least", [1 << 16, 30])
def test_pieces(spark, monkeypatch, least):
    monkeypatch.setattr(segments, "LEAST", least)
    draw = random.Random(2)
    rows = [(g if g else None, p, draw.choice([None, 0, 2, 3, 5, 8, 13])) for g in range(30) for p in range(draw.randrange(0, 9))] + [(77, p, 4) for p in range(200)]
    targets = [(g if g else None, draw.randrange(0, 30)) for g in range(30)] + [(77, 400), (78, 0), (79, 5), (80, None), (81, -2)]
    pieces = spark.createDataFrame(rows, "grp long, pos long, tokens int").withColumn("take", F.lit("clash"))
    told, picked = fitting.fit_exact(pieces, spark.createDataFrame(targets, "grp long, target int"))
    got = {}
    for r in picked.collect():
        got.setdefault(r["grp"], []).append((r["tokens"], r["pos"]))
    want_possible, want = {}, {}
    for g, target in targets:
        sizes = {}
        for h, p, t in rows:
            if h == g and t:
                sizes.setdefault(t, []).append(p)
        counts = None if target is None else fitting.counts_for(target, sorted(((t, len(p)) for t, p in sizes.items()), reverse=True))
        want_possible[g] = counts is not None
        taken = [(t, p) for t, c in zip(sorted(sizes, reverse=True), counts or []) for p in sorted(sizes[t])[:c]]
        if taken:
            want[g] = sorted(taken)
            assert sum(t for t, _ in taken) == target
    assert {r["grp"]: r["possible"] for r in told.collect()} == want_possible
    assert {g: sorted(v) for g, v in got.items()} == want
    assert len(want[77]) == 100
