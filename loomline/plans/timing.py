"""Queries of waits in time and of the order of events; users stand for keys, orders for requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import patterns, waits
from loomline.plans.registry import SQL, Fixture, query
from loomline.streaming import timed
from loomline.tables import new_path

_STATE = "CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'SIDECAR_RUNNING' WHEN 'purchase' THEN 'READY' WHEN 'signup' THEN 'READY' WHEN 'error' THEN 'EXPIRED' END"
_START = 1_704_067_200_000
#: Two keys a request, which may be the same; a wait of 6 to 18 hours that begins within 30 days.
_SINCE = f"{_START} + o_orderkey * 7919 % 2592000 * 1000"
_ASK = {"request": "o_orderkey", "a": "o_custkey % 15", "b": "o_orderkey % 13", "since": _SINCE, "hours": "o_orderkey % 3 * 6 + 6"}
ASK = Fixture("o", "orders", _ASK)
_LOG_SQL = f"log AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS time, arg_max({_STATE}, event_id) AS state FROM events GROUP BY ALL)"
_ASK_SQL = f"{ASK.sql}, q AS (SELECT DISTINCT request, unnest([a, b]) AS key, since::BIGINT AS since, (since + hours * 3600000)::BIGINT AS deadline FROM o)"
_HOUR = 3_600_000


def _log(spark, sf):
    return Fixture("v", "events", {"key": "user_id", "at": "unix_millis(CAST(ts AS timestamp))", "seq": "event_id", "state": _STATE})(spark, sf)


def _asked(spark, sf):
    rows = ASK(spark, sf)
    return rows.select("request", F.explode(F.array_distinct(F.array("a", "b"))).alias("key"), F.col("since").cast("long").alias("since"), (F.col("since") + F.col("hours") * _HOUR).cast("long").alias("deadline"))


def _states_sql(name: str, moments: str, keys: str = "q") -> str:
    """The state of each key of a request at its moments."""
    return f"{name} AS (SELECT m.request, m.time, k.key, l.state FROM {moments} m JOIN {keys} k USING (request) ASOF LEFT JOIN log l ON l.key = k.key AND m.time >= l.time)"


@query(f"""WITH {_LOG_SQL}, {_ASK_SQL}, m AS (SELECT request, since AS time FROM q UNION SELECT request, log.time FROM q JOIN log USING (key) WHERE log.time > since AND log.time <= deadline), {_states_sql("s", "m")},
met AS (SELECT request, min(time) AS met FROM (SELECT request, time FROM s GROUP BY ALL HAVING bool_and(coalesce(state = 'READY', FALSE))) GROUP BY 1),
e AS (SELECT request, any_value(since) AS since, coalesce(any_value(met), any_value(deadline)) AS time, any_value(met) IS NOT NULL AS done FROM q LEFT JOIN met USING (request) GROUP BY 1), {_states_sql("z", "e")}
SELECT request, any_value(done) AS done, any_value(e.time - since)::BIGINT AS waited, count(*) AS n_keys, count(*) FILTER (state = 'READY') AS n_ready FROM z JOIN e USING (request) GROUP BY 1""")
def wait_for_states(spark, sf):
    ends, states = waits.wait(_log(spark, sf), _asked(spark, sf), F.col("state") == "READY")
    counts = states.groupBy("request").agg(F.count("*").alias("n_keys"), F.count_if(F.col("state") == "READY").alias("n_ready"))
    return ends.join(counts, "request").select("request", "done", "waited", "n_keys", "n_ready")


@query(f"""WITH {_LOG_SQL}, {_ASK_SQL}, m AS (SELECT request, since AS time FROM q UNION SELECT request, log.time FROM q JOIN log USING (key) WHERE log.time > since AND log.time <= since + {2 * _HOUR}), {_states_sql("s", "m")},
met AS (SELECT request, min(time) AS met FROM (SELECT request, time FROM s GROUP BY ALL HAVING NOT bool_or(coalesce(state IN ('QUEUED', 'SIDECAR_RUNNING'), FALSE))) GROUP BY 1),
e AS (SELECT request, any_value(since) AS since, coalesce(any_value(met), any_value(since) + {2 * _HOUR}) AS time FROM q LEFT JOIN met USING (request) GROUP BY 1), {_states_sql("t", "e")},
q2 AS (SELECT request, key, time AS since FROM t WHERE state = 'SIDECAR_RUNNING'),
m2 AS (SELECT request, log.time FROM q2 JOIN log USING (key) WHERE log.time > since AND log.time <= since + {9 * _HOUR}), {_states_sql("s2", "(SELECT DISTINCT * FROM m2)", "q2")},
met2 AS (SELECT request, min(time) AS met FROM (SELECT request, time FROM s2 GROUP BY ALL HAVING NOT bool_or(coalesce(state = 'SIDECAR_RUNNING', FALSE))) GROUP BY 1),
e2 AS (SELECT request, any_value(e.since) AS since, any_value(e.time) AS first, coalesce(any_value(met), any_value(q2.since) + {9 * _HOUR}, any_value(e.time)) AS time FROM e LEFT JOIN q2 USING (request) LEFT JOIN met2 USING (request) GROUP BY 1), {_states_sql("z", "e2")}
SELECT request, any_value(first - since)::BIGINT AS near_ms, any_value(e2.time - first)::BIGINT AS running_ms, count(*) FILTER (state = 'READY') AS n_ready, count(*) FILTER (state IN ('QUEUED', 'SIDECAR_RUNNING')) AS n_unresolved FROM z JOIN e2 USING (request) GROUP BY 1""")
def source_plan_waits(spark, sf):
    """What requests wait before their sources are decided, and the states on which they are."""
    times, states = waits.plan_states(_log(spark, sf), _asked(spark, sf).drop("deadline"), 2 * _HOUR, 9 * _HOUR)
    counts = states.groupBy("request").agg(F.count_if(F.col("state") == "READY").alias("n_ready"), F.count_if(F.col("state").isin(*waits.UNRESOLVED)).alias("n_unresolved"))
    return times.join(counts, "request")


@query(f"""WITH {_LOG_SQL}, {_ASK_SQL}, m AS (SELECT request, since AS time FROM q UNION SELECT request, log.time FROM q JOIN log USING (key) WHERE log.time > since AND log.time <= deadline), {_states_sql("s", "m")},
met AS (SELECT request, min(time) AS met FROM s WHERE state = 'READY' GROUP BY 1), n AS (SELECT s.request, count(*) AS n_first, min(key) AS first_key FROM s JOIN met ON met.request = s.request AND met.met = s.time WHERE state = 'READY' GROUP BY ALL)
SELECT q.request, met IS NOT NULL AS done, (coalesce(met, deadline) - since)::BIGINT AS waited, coalesce(n_first, 0) AS n_first, first_key FROM (SELECT DISTINCT request, since, deadline FROM q) q LEFT JOIN met USING (request) LEFT JOIN n USING (request)""")
def wait_for_any(spark, sf):
    """When the first key of each request is ready, and which."""
    ends, first = waits.wait_for_any(_log(spark, sf), _asked(spark, sf), F.col("state") == "READY")
    first = first.groupBy("request").agg(F.count("*").alias("n_first"), F.min("key").alias("first_key"))
    return ends.join(first, "request", "left").select("request", "done", "waited", F.coalesce("n_first", F.lit(0)).alias("n_first"), "first_key")


_KIND = "CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'probed' WHEN 'purchase' THEN 'ready' WHEN 'signup' THEN 'ready_put_done' WHEN 'error' THEN 'failed' END"
RUNS = Fixture("r", "events", {"item": "user_id", "run": "event_id % 40", "seq": "event_id", "kind": _KIND})


@query(f"""WITH {RUNS.sql}, w AS (SELECT item, run, count(*) AS n, list(kind ORDER BY seq) AS kinds, string_agg(coalesce(CASE kind WHEN 'ready_put_done' THEN 'd' ELSE left(kind, 1) END, '-'), '' ORDER BY seq) AS word FROM r GROUP BY ALL),
b AS (SELECT *, list_filter(range(n), lambda i: left(word, i + 1) NOT IN ('s', 'sp', 'sr', 'sd', 'sf', 'srd', 'sdr', 'spr', 'spd', 'spf', 'sprd', 'spdr'))[1] AS i FROM w)
SELECT item, run, n, i AS at, kinds[i + 1] AS event, CASE WHEN i IS NOT NULL THEN 'broken' WHEN word IN ('srd', 'sdr', 'sf', 'sprd', 'spdr', 'spf') THEN 'complete' ELSE 'open' END AS verdict FROM b""")
def emission_order(spark, sf):
    """The first event of each run that a worker doesn't emit there."""
    return patterns.first_break(RUNS(spark, sf), ["item", "run"], ["seq"], "kind")


#: Hours that a ready entry stays cached.
TTL = 12 * _HOUR
_EVENT = "CASE event_type WHEN 'view' THEN 'prepare' WHEN 'click' THEN 'started' WHEN 'purchase' THEN 'ready' WHEN 'signup' THEN 'evict' WHEN 'error' THEN 'failed' END"
TIMED = Fixture("v", "events", {"key": "user_id", "at": "CAST(ts AS timestamp)", "seq": "event_id", "event": _EVENT, "epoch": "CAST(1 + event_id % 3 AS INT)"})


def _timed(spark, sf):
    fixed = {"request": F.lit("r"), "idx": F.lit(0), "ok": F.lit(True), "worker": F.lit(0)}
    rows = TIMED(spark, sf)
    return rows.select(*(F.col(n) if n in rows.columns else fixed.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in timed.EVENTS.split(", "))))


def _by_key(changes):
    counts = (F.count_if(F.col("what") == w).alias(n) for w, n in (("state", "changes"), ("expired", "expired")))
    return changes.groupBy("key").agg(F.max_by("state", F.struct("at", "epoch")).alias("state"), F.max("epoch").alias("epoch"), *counts, F.max("at").alias("last_at"))


@query(f"""WITH RECURSIVE x AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS time, {_EVENT} AS event, (1 + event_id % 3)::INT AS xe, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
f AS (
  SELECT DISTINCT key, 0::BIGINT AS k, NULL::VARCHAR AS state, 0 AS epoch, NULL::BIGINT AS until, 0::BIGINT AS changes, 0::BIGINT AS expired, NULL::BIGINT AS last_at FROM x
  UNION ALL
  SELECT key, k, next, next_epoch, CASE WHEN event = 'evict' THEN NULL WHEN event = 'ready' AND fits THEN time + {TTL} ELSE kept END,
    changes + (next IS DISTINCT FROM held OR next_epoch <> epoch)::INT, expired + ran::INT, CASE WHEN next IS DISTINCT FROM held OR next_epoch <> epoch THEN time WHEN ran THEN until ELSE last_at END
  FROM (
    SELECT *, CASE WHEN event = 'prepare' THEN CASE WHEN held IN ('QUEUED', 'SIDECAR_RUNNING', 'READY') THEN held WHEN kept IS NOT NULL THEN 'READY' ELSE 'QUEUED' END
        WHEN event = 'started' AND fits AND held = 'QUEUED' THEN 'SIDECAR_RUNNING' WHEN event = 'ready' AND fits THEN 'READY' WHEN event = 'failed' AND fits THEN 'FAILED' ELSE held END AS next,
      epoch + (event = 'prepare' AND coalesce(held NOT IN ('QUEUED', 'SIDECAR_RUNNING', 'READY'), TRUE))::INT AS next_epoch
    FROM (
      SELECT f.* EXCLUDE (k), x.k, x.time, x.event, coalesce(until <= x.time AND state = 'READY', FALSE) AS ran, CASE WHEN until <= x.time AND state = 'READY' THEN 'EXPIRED' ELSE state END AS held,
        CASE WHEN until > x.time THEN until END AS kept, state IS NOT NULL AND x.xe = epoch AS fits
      FROM f JOIN x ON x.key = f.key AND x.k = f.k + 1
    )
  )
), z AS (SELECT *, until IS NOT NULL AND state = 'READY' AS ran FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k DESC) AS last FROM f) WHERE last = 1)
SELECT key, CASE WHEN ran THEN 'EXPIRED' ELSE state END AS state, epoch, changes, expired + ran::INT AS expired, CASE WHEN ran THEN until ELSE last_at END AS last_at FROM z WHERE changes > 0""")
def timed_lifecycle(spark, sf):
    """What became of each key's entry in event time, entries running out by themselves."""
    return _by_key(timed.fold(_timed(spark, sf), TTL))


@query(SQL["timed_lifecycle"])
def timed_stream(spark, sf):
    """The same as a stream over files in which the events are shuffled over days, started anew for each part."""
    rows = _timed(spark, sf)
    folder, store = new_path(spark), "spark.sql.streaming.stateStore.providerClass"
    span = rows.agg(F.min("at").alias("a"), F.max("at").alias("z")).first()
    half = rows.withColumn("late", F.unix_millis("at") + F.col("seq") % 5 * 24 * _HOUR > F.unix_millis(F.lit(span["a"])) + 15 * 24 * _HOUR)
    tick = rows.sparkSession.range(1).select(*((F.lit(-1).cast(t) if n == "key" else F.timestamp_millis(F.unix_millis(F.lit(span["z"])) + 90 * 24 * _HOUR) if n == "at" else F.lit(None).cast(t)).alias(n) for n, t in (f.split() for f in timed.EVENTS.split(", "))))
    old = spark.conf.get(store)
    spark.conf.set(store, timed.ROCKS)
    try:
        for part in (half.where("not late").drop("late"), half.where("late or late is null").drop("late"), tick):
            part.write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(timed.EVENTS).parquet(f"{folder}/in")
            out = timed.stream(source, TTL, "35 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
            out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, old)
    return _by_key(spark.read.schema(timed.CHANGES).parquet(f"{folder}/out"))
