import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators.waits import TERMINAL
from loomline.streaming import lifecycle as L
from loomline.streaming import timed as T

START = 1_700_000_000_000
COLUMNS = [c.split()[0] for c in T.EVENTS.split(", ")]
TTL = 5_000


def moment(ms):
    return datetime.datetime.fromtimestamp((START + ms) / 1000, datetime.timezone.utc)


def drawn(seed, n=260, span=60_000):
    draw = random.Random(seed)
    kinds = ["prepare"] * 3 + ["started", "probed", "ready", "ready", "failed", "claim", "evict", "fetch", "wait", "wait"]
    maybe = lambda x: x if draw.random() < 0.3 else None
    out = []
    for i in range(n):
        kind = draw.choice(kinds)
        out.append((draw.choice([1, 1, 2, 3, 4, 5, 6, 7]), draw.randrange(0, span, 50), i, kind, draw.randrange(1, 6), "r", 0, f"w{i}", maybe(i), None, None, True, maybe("e"), 0, draw.choice([0, 50, 500, 20_000])))
    return out + [(8, 100, n, "prepare", None, "r", 0, None, None, None, None, None, None, 0, None), (8, 200, n + 1, "ready", 1, "r", 0, None, 4, None, None, True, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(r[0], moment(r[1]), *r[2:]) for r in rows], T.EVENTS)


def stepped(rows, until):
    """Every moment in turn: the cache runs out, then events, then deadlines."""
    out = []
    for key in {r[0] for r in rows}:
        entry, expires, waits = L.Entry(), None, {}
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        moments = sorted({r[1] for r in own} | {r[1] + TTL for r in own} | {r[1] + (r[14] or 0) for r in own})

        def told(at, what, wait=None):
            out.append((key, START + at, what, wait, entry.state or "ABSENT", entry.epoch))

        def check(at):
            if entry.item is not None or entry.state in TERMINAL:
                for name in waits:
                    told(at, "met", name)
                waits.clear()

        for at in (m for m in moments if m <= until):
            if expires == at:
                expires, entry.cached = None, False
                if entry.state == "READY":
                    entry.state = "EXPIRED"
                    told(at, "expired")
                    check(at)
            for r in own:
                if r[1] != at:
                    continue
                e = dict(zip(COLUMNS, r))
                if e["event"] == "wait":
                    waits[e["claimer"]] = at + e["wait_ms"]
                else:
                    before = entry.state, entry.epoch
                    if entry.apply(e) and e["event"] == "ready":
                        expires = at + TTL
                    expires = expires if entry.cached else None
                    if (entry.state, entry.epoch) != before:
                        told(at, "state")
                check(at)
            for name in [n for n, d in waits.items() if d == at]:
                del waits[name]
                told(at, "deadline", name)
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_batch(spark, seed):
    rows = drawn(seed)
    df = frame(spark, rows)
    assert got(T.fold(df, TTL)) == stepped(rows, 10**9)
    assert got(T.fold(df, TTL, START + 30_000)) == stepped([r for r in rows if r[1] <= 30_000], 30_000)
    nothing = df.withColumn("key", F.when(F.col("seq") % 2 == 0, F.col("key")))
    assert got(T.fold(nothing, TTL)) == stepped([r for r in rows if r[2] % 2 == 0], 10**9)
    assert T.fold(df.where("seq < 0"), TTL).count() == 0
    what = {r["what"] for r in T.fold(df, TTL).collect()}
    assert what == {"state", "expired", "met", "deadline"}


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_stream_equals_batch_over_a_restart(spark, rocks, tmp_path):
    rows = drawn(7)
    draw = random.Random(3)
    # Shuffled within ten seconds, then a late event, and an event far off that moves the watermark past all.
    files = [[], [], [], []]
    for r in rows:
        files[min(3, max(0, (r[1] + draw.randrange(-9_000, 9_000)) // 15_000))].append(r)
    late = [(1, 5, 9_999, "prepare", None, "late", 0, None, None, None, None, None, None, 0, None)]
    tick = [(-1, 10**8, 10**6, "odd", None, None, None, None, None, None, None, None, None, None, None)]

    def run(*parts):
        for part in parts:
            frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(T.EVENTS).parquet(f"{tmp_path}/in")
            q = T.stream(source, TTL, "25 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None

    run(files[0], files[1], files[2])
    out = spark.read.schema(T.CHANGES).parquet(f"{tmp_path}/out")
    early = got(out)
    want = stepped(rows, 10**9)
    assert 0 < len(early) < len(want) and set(early) <= set(want)  # what is told early stays true
    run(files[3], late, tick)
    assert got(spark.read.schema(T.CHANGES).parquet(f"{tmp_path}/out")) == want
