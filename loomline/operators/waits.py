"""Waits in time: when all of a request's keys are in a wanted state at once, from a log of state changes.

A log has rows (key, at, seq, state): the key is in the state from ``at`` milliseconds on; of one moment the largest seq counts. What a
key was before its first change is null. A state may be left again before the others of a request have come, so a sweep over
the request's changes counts the keys that are in a wanted state at each moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.segments import latest, scan
from loomline.tables import written

UNRESOLVED = ("QUEUED", "SIDECAR_RUNNING")
#: States in which nothing more is learned of an image.
TERMINAL = ("READY", "FAILED", "EXPIRED", "FALLBACK_CLAIMED", "FALLBACK_LOCAL_DONE", "BYPASS")


def as_of(log: DataFrame, asked: DataFrame, at: str = "at") -> DataFrame:
    """``asked(key, at, ...)`` with the key's ``state`` at that moment, null before its first change."""
    columns = asked.columns
    marks = asked.select("key", F.col(at).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("struct<state: string>").alias("s"), F.struct(*(F.col(c) for c in columns)).alias("row"))
    changes = log.select("key", "at", F.lit(0).alias("kind"), F.col("seq").cast("long").alias("seq"), F.struct(F.col("state").cast("string").alias("state")).alias("s"), F.lit(None).cast(marks.schema["row"].dataType).alias("row"))
    known = latest(changes.unionByName(marks), ["key"], ["at", "kind", "seq"], F.col("s"), "known").where("kind = 1")
    return known.select("row.*", F.col("known.state").alias("state"))


def wait(log: DataFrame, asked: DataFrame, wanted: Column, least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What becomes of ``asked(request, key, since, deadline)``, whose rows of a request have the same times and different keys.

    Gives (request, done, at, waited), ``at`` being the first moment from ``since`` on at which ``wanted``, a predicate of ``state``, holds for all
    keys at once, or for ``least`` of them (all, where a request has fewer), or the deadline, and the keys' states then: (request, key, state). A null predicate doesn't hold; a key that the
    log doesn't have is in the null state. A null request or key is one like others. A request without rows has no result.
    """
    ok = F.coalesce(wanted, F.lit(False)).cast("int")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))  # noqa: E731  joins find null keys too
    log = log.select(name("key").alias("key"), "at", "seq", "state")
    asked = written(asked.select("request", name("request").alias("r"), F.col("key").alias("k"), name("key").alias("key"), "since", "deadline"))
    # Changes and waits meet by key and stretch of time, which is as long as the longest wait, so a wait reaches into two.
    width = max(1, asked.agg(F.max(F.col("deadline") - F.col("since"))).first()[0] or 0)
    stretch = lambda c: F.floor(F.col(c) / width)
    spread = asked.withColumn("stretch", F.explode(F.sequence(stretch("since"), F.greatest(stretch("since"), stretch("deadline")))))
    during = spread.join(log.withColumn("stretch", stretch("at")), ["key", "stretch"]).where("at > since and at <= deadline").select("r", "key", "at", "seq", "state")
    start = as_of(log, asked.select("r", "key", F.col("since").alias("at"))).select("r", "key", "at", F.lit(None).cast("long").alias("seq"), "state")
    last = F.max_by(F.struct("state"), F.struct(F.coalesce("seq", F.lit(-(1 << 62)))))
    points = written(start.unionByName(during).groupBy("r", "key", "at").agg(last.alias("s")).select("r", "key", "at", F.col("s.state").alias("state")).withColumn("ok", ok))
    # A key counts by how its points change the number of its request's keys that are as wanted.
    steps = latest(points, ["r", "key"], ["at"], F.col("ok"), "was", own=False).withColumn("step", F.col("ok") - F.coalesce("was", F.lit(0)))
    moments = steps.groupBy("r", "at").agg(F.sum("step").alias("step"))
    counts = scan(moments, ["r"], ["at"], F.col("step"), before="held")
    sizes = asked.groupBy("r").agg(F.first(F.struct("request")).alias("q"), F.count("*").alias("keys"), F.min("since").alias("since"), F.max("deadline").alias("deadline"))
    met = counts.join(sizes.select("r", "keys"), "r").where(F.col("held") + F.col("step") >= (F.col("keys") if least is None else F.least("keys", F.lit(least)))).groupBy("r").agg(F.min("at").alias("met"))
    ends = sizes.join(met, "r", "left")
    at = F.coalesce("met", F.greatest("since", "deadline"))
    ends = written(ends.select("r", "q.request", F.col("met").isNotNull().alias("done"), at.alias("at"), (at - F.col("since")).alias("waited")))
    seen = points.join(ends.select("r", F.col("at").alias("_end")), "r").where("at <= _end").groupBy("r", "key").agg(F.max_by(F.struct("state"), "at").alias("s"))
    states = asked.select("r", "request", "k", "key").join(seen, ["r", "key"]).select("request", F.col("k").alias("key"), "s.state")
    return ends.drop("r"), states


def wait_for_any(log: DataFrame, asked: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame]:
    """``wait`` until one key is as wanted, and the keys that are then: (request, key), several where they came in the same moment."""
    ends, states = wait(log, asked, wanted, 1)
    return ends, states.where(wanted).select("request", "key")


def wait_for_metadata(log: DataFrame, asked: DataFrame, probed: Column) -> tuple[DataFrame, DataFrame]:
    """``wait`` until each key is ``probed``, a predicate of the state, or in a state in which it won't be any more."""
    return wait(log, asked, probed | F.col("state").isin(*TERMINAL))


def plan_states(log: DataFrame, asked: DataFrame, near_ms: int, running_ms: int) -> tuple[DataFrame, DataFrame]:
    """The states on which requests ``asked(request, key, since)`` are decided: (request, near_ms, running_ms), what they waited, and (request, key, state).

    A request with unresolved keys first waits until none is, for ``near_ms`` at most; if keys are running then, it waits until none
    of those is, for ``running_ms`` at most, and then looks at all keys again.
    """
    resolved = ~F.col("state").isin(*UNRESOLVED) | F.col("state").isNull()
    first, seen = wait(log, asked.withColumn("deadline", F.col("since") + near_ms), resolved)
    first, seen = written(first), written(seen)
    running = seen.where("state = 'SIDECAR_RUNNING'").select("request", "key") if running_ms > 0 else seen.where("false").select("request", "key")
    left = lambda df: df.withColumnRenamed("request", "_r")
    again = running.join(left(first.select("request", "at")), F.col("request").eqNullSafe(F.col("_r"))).select("request", "key", F.col("at").alias("since"), (F.col("at") + running_ms).alias("deadline"))
    second, _ = wait(log, again, F.coalesce(F.col("state") != "SIDECAR_RUNNING", F.lit(True)))
    both = first.join(left(second.select("request", F.col("at").alias("end"), F.col("waited").alias("ran"))), F.col("request").eqNullSafe(F.col("_r")), "left").drop("_r")
    both = written(both.select("request", F.col("waited").alias("near_ms"), F.coalesce("ran", F.lit(0)).alias("running_ms"), F.coalesce("end", "at").alias("at")))
    final = as_of(log, asked.join(left(both.select("request", "at")), F.col("request").eqNullSafe(F.col("_r"))).select("request", "key", "at"))
    return both.drop("at"), final.select("request", "key", "state")
