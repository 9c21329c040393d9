import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from loomline.operators import patterns, segments, waits

LOG, ASKED = "key string, at long, seq long, state string", "request string, key string, since long, deadline long"
STATES = ["QUEUED", "SIDECAR_RUNNING", "READY", "FAILED", "EXPIRED", None]


def state_at(log, key, t):
    own = [(at, seq, state) for k, at, seq, state in log if k == key and at <= t]
    return max(own, key=lambda r: r[:2])[2] if own else None


def polled(log, rows, ok, enough=all):
    """Every millisecond, as a poll without a pause would see it."""
    out, states = {}, {}
    for request, own in itertools.groupby(sorted(rows, key=lambda r: r[0] or ""), key=lambda r: r[0]):
        own = list(own)
        since, deadline = own[0][2:]
        t = since
        while not (done := enough(ok(state_at(log, r[1], t)) for r in own)) and t < deadline:
            t += 1
        out[request] = (done, t, t - since)
        states |= {(request, r[1]): state_at(log, r[1], t) for r in own}
    return out, states


def drawn(seed):
    draw = random.Random(seed)
    keys = ["hot"] * 3 + [f"k{i}" for i in range(6)] + [None]
    log = [(draw.choice(keys), draw.randrange(200), i, draw.choice(STATES)) for i in range(250)]
    log += [("same", 50, 1000 + i, s) for i, s in enumerate(["READY", "FAILED", "READY", "QUEUED"])] + [("same", 51, 2000, "READY")]
    rows = []
    for q in range(40):
        since = draw.randrange(-5, 205)
        times = (since, since + draw.choice([0, 1, 10, 60, -3]))
        rows += [(f"q{q}" if q else None, k, *times) for k in {draw.choice([*keys, "same", "never"]) for _ in range(draw.randrange(1, 5))}]
    rows += [("exact", "same", 50, 60), ("gone", "never", 5, 9)]
    return log, rows


def ready(state):
    return state == "READY"


@pytest.mark.parametrize("seed,least", [(1, 1 << 16), (2, 20)])
def test_wait_equals_polling(spark, monkeypatch, seed, least):
    monkeypatch.setattr(segments, "LEAST", least)
    log, rows = drawn(seed)
    df, asked = spark.createDataFrame(log, LOG).withColumn("kind", F.lit("clash")), spark.createDataFrame(rows, ASKED)
    got, states = waits.wait(df, asked, F.col("state") == "READY")
    want, seen = polled(log, rows, ready)
    assert {r["request"]: (r["done"], r["at"], r["waited"]) for r in got.collect()} == want
    assert {(r["request"], r["key"]): r["state"] for r in states.collect()} == seen
    assert want["exact"] == (True, 51, 1)  # of one moment the last change counts
    got, _ = waits.wait_for_metadata(df, asked, F.col("state") == "SIDECAR_RUNNING")
    want, _ = polled(log, rows, lambda s: s == "SIDECAR_RUNNING" or s in waits.TERMINAL)
    assert {r["request"]: (r["done"], r["at"], r["waited"]) for r in got.collect()} == want
    got, first = waits.wait_for_any(df, asked, F.col("state") == "READY")
    want, seen = polled(log, rows, ready, any)
    assert {r["request"]: (r["done"], r["at"], r["waited"]) for r in got.collect()} == want
    assert {(r["request"], r["key"]) for r in first.collect()} == {k for k, s in seen.items() if s == "READY"}
    got, _ = waits.wait(df, asked, F.col("state") == "READY", 2)
    want, _ = polled(log, rows, ready, lambda x: sum(x := list(x)) >= min(2, len(x)))
    assert {r["request"]: (r["done"], r["at"], r["waited"]) for r in got.collect()} == want
    empty = waits.wait(df, asked.where("since > 9999"), F.col("state") == "READY")
    assert empty[0].count() == 0 and empty[1].count() == 0
    assert waits.wait(df.where("at < 0"), asked, F.col("state") == "READY")[0].where("done").count() == 0


def test_ready_and_expired_again(spark):
    log = spark.createDataFrame([("a", 10, 0, "READY"), ("a", 20, 1, "EXPIRED"), ("b", 25, 2, "READY"), ("a", 40, 3, "READY")], LOG)
    asked = spark.createDataFrame([("q", "a", 5, 30), ("q", "b", 5, 30), ("r", "a", 5, 60), ("r", "b", 5, 60)], ASKED)
    got, states = waits.wait(log, asked, F.col("state") == "READY")
    assert {tuple(r) for r in got.collect()} == {("q", False, 30, 25), ("r", True, 40, 35)}  # both were ready, but never at once before 40
    assert {tuple(r) for r in states.collect()} == {("q", "a", "EXPIRED"), ("q", "b", "READY"), ("r", "a", "READY"), ("r", "b", "READY")}


def test_plan_waits_twice(spark):
    log = [("a", 0, 0, "QUEUED"), ("a", 2, 1, "SIDECAR_RUNNING"), ("a", 30, 2, "READY"), ("b", 0, 3, "QUEUED"), ("b", 12, 4, "READY"), ("c", 0, 5, "READY"), ("d", 0, 6, "SIDECAR_RUNNING"), ("d", 90, 7, "READY"), ("c", 15, 8, "EXPIRED")]
    asked = [("both", "a", 1), ("both", "b", 1), ("both", "c", 1), ("long", "d", 1), ("none", "c", 1), ("soon", "b", 11)]
    times, states = waits.plan_states(spark.createDataFrame(log, LOG), spark.createDataFrame(asked, "request string, key string, since long"), 5, 40)
    # [both] 5 ms for all, then a runs: its 24 ms until 30; b and c are looked at again then.
    assert {tuple(r) for r in times.collect()} == {("both", 5, 24), ("long", 5, 40), ("none", 0, 0), ("soon", 1, 0)}
    assert {tuple(r) for r in states.collect()} == {("both", "a", "READY"), ("both", "b", "READY"), ("both", "c", "EXPIRED"), ("long", "d", "SIDECAR_RUNNING"), ("none", "c", "READY"), ("soon", "b", "READY")}
    times, _ = waits.plan_states(spark.createDataFrame(log, LOG), spark.createDataFrame(asked, "request string, key string, since long"), 5, 0)
    assert {r["running_ms"] for r in times.collect()} == {0}


LETTERS = {"started": "s", "probed": "p", "ready": "r", "ready_put_done": "d", "failed": "f", "odd": "o", None: "n"}
REGEX = "s p? (rd | dr | f)".replace(" ", "")


def verdict(kinds):
    word = "".join(LETTERS[k] for k in kinds)
    whole = {w for n in range(6) for w in map("".join, itertools.product("sprdf", repeat=n)) if re.fullmatch(REGEX, w)}
    for i in range(len(word)):
        if not any(w.startswith(word[: i + 1]) for w in whole):
            return (len(word), i, kinds[i], "broken")
    return (len(word), None, None, "complete" if word in whole else "open")


@pytest.mark.parametrize("block,least", [(1024, 1 << 16), (2, 20)])
def test_emission_order(spark, monkeypatch, block, least):
    monkeypatch.setattr(patterns, "BLOCK", block)
    monkeypatch.setattr(segments, "LEAST", least)
    draw = random.Random(block)
    words = [["started", "probed", "ready", "ready_put_done"], ["started", "ready_put_done", "ready"], ["started", "failed"], ["started", "probed", "failed"], ["started", "probed", "ready_put_done"], ["ready_put_done", "ready"]]
    words += [[draw.choice(list(LETTERS)[: draw.choice([5, 7])]) for _ in range(draw.randrange(1, 7))] for _ in range(150)] + [["started", *["odd"] * 80], ["started"]]
    rows = [(None if g == 3 else g, 1, i, k) for g, w in enumerate(words) for i, k in enumerate(w)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "item long, epoch int, seq long, kind string").withColumn("block", F.lit("clash"))
    got = {r["item"]: (r["n"], r["at"], r["event"], r["verdict"]) for r in patterns.first_break(df, ["item", "epoch"], ["seq"], "kind").collect()}
    assert got == {None if g == 3 else g: verdict(w) for g, w in enumerate(words)}
    assert patterns.first_break(df.where("seq < 0"), ["item"], ["seq"], "kind").count() == 0


def test_other_patterns():
    again = (patterns.STAR, (patterns.SEQ, "a", (patterns.OPT, "b")))
    steps, done = patterns.automaton((patterns.ALL, "x", again, "y"))
    for word, want in {"xy": True, "yabax": True, "axy": True, "xaby": True, "abaxy": True, "yxaab": True, "xx": None, "x": False, "bxy": None, "xyabb": None, "": False}.items():
        state = 0
        for c in word:
            state = steps[state].get(c) if state is not None else None
        assert (None if state is None else done[state]) == want, word
