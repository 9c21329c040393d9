"""Queries of features, gates and profiles. Order lines stand for images of requests, events for runs and timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import features as T
from loomline.operators import gates as G
from loomline.operators import profiles as P
from loomline.plans.registry import Fixture, query

LINES = Fixture("l", "lineitem", {"req": "l_orderkey", "pos": "CAST(l_linenumber AS BIGINT)", "pk": "l_partkey", "sk": "l_suppkey"})
#: One row a request and position, as order lines may repeat theirs.
ONCE = f"{LINES.sql}, o AS (SELECT req, pos, min(pk) AS pk, min(sk) AS sk FROM l GROUP BY ALL)"


def _once(spark, sf):
    return LINES(spark, sf).groupBy("req", "pos").agg(F.min("pk").alias("pk"), F.min("sk").alias("sk"))


@query(f"""WITH {ONCE}, i AS (SELECT req, pos, coalesce(CASE WHEN pk % 3 <> 0 THEN (pk % 4)::INT END, pos::INT) AS idx, pk FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY req, idx ORDER BY pos DESC) AS k FROM i) SELECT req, idx, pos, pk FROM r WHERE k = 1""")
def planned_by_index(spark, sf):
    rows = _once(spark, sf).withColumn("idx", F.when(F.col("pk") % 3 != 0, (F.col("pk") % 4).cast("int")))
    return T.by_index(rows, "req", "idx", "pos").select("req", "idx", "pos", "pk")


@query("WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN ' 7 ' WHEN 2 THEN NULL WHEN 3 THEN event_id::VARCHAR ELSE '-3' END AS t FROM events) SELECT event_id, trim(t)::INT AS idx FROM t WHERE regexp_matches(t, '^\\s*-?\\d+\\s*$')")
def usable_indexes(spark, sf):
    rows = Fixture("t", "events", {"event_id": "event_id", "t": "CASE event_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN ' 7 ' WHEN 2 THEN NULL WHEN 3 THEN CAST(event_id AS VARCHAR(20)) ELSE '-3' END"})
    return T.usable_indexes(rows(spark, sf), "t").select("event_id", "idx")


@query(f"WITH {ONCE} SELECT req, pos, CASE WHEN pk % 3 = 0 THEN 'local' ELSE 'remote' END AS place FROM o WHERE sk % 2 = 0")
def shard_split(spark, sf):
    rows = _once(spark, sf)
    return T.shard_split(rows.where("sk % 2 = 0").select("req", "pos"), rows.where("pk % 3 = 0"), ["req", "pos"])


@query(f"WITH {ONCE} SELECT req, pos, pk % 5 <> 0 AND sk % 2 = 0 AS replaced, CASE WHEN pk % 5 <> 0 AND sk % 2 = 0 THEN pk * 10 ELSE sk END AS data FROM o")
def replace_features(spark, sf):
    rows = _once(spark, sf)
    features = rows.select("req", "pos", F.when(F.col("pk") % 5 == 0, "audio").otherwise("image").alias("modality"), F.col("sk").alias("data"))
    artifacts = rows.where("sk % 2 = 0").select("req", "pos", (F.col("pk") * 10).alias("data"))
    return T.attach(features, artifacts, ["req", "pos"], "data").drop("modality")


@query(f"WITH {ONCE} SELECT req, pos, (sk % 50)::BIGINT AS place, pk * 2 AS nbytes FROM o WHERE pk % 2 = 0 AND sk % 3 = 0")
def reorder_artifacts(spark, sf):
    rows = _once(spark, sf)
    wanted = rows.where("pk % 2 = 0").select("req", "pos", (F.col("sk") % 50).alias("place"))
    return T.in_order(rows.where("sk % 3 = 0").select("req", "pos", (F.col("pk") * 2).alias("nbytes")), wanted, ["req", "pos"], "place")


GRIDS = f"{ONCE}, g AS (SELECT req, pos, CASE WHEN pk % 3 = 0 THEN pk WHEN sk % 4 <> 0 THEN -sk END AS grid FROM o)"


@query(f"WITH {GRIDS} SELECT * FROM g")
def grid_resolve(spark, sf):
    rows = _once(spark, sf)
    planned, features = rows.where("pk % 3 = 0").withColumn("grid", F.col("pk")), rows.where("sk % 4 <> 0").withColumn("grid", -F.col("sk"))
    return T.resolved_grids(rows.select("req", "pos"), planned, features, ["req", "pos"])


@query(f"WITH {GRIDS} SELECT req, pos, grid FROM g WHERE req NOT IN (SELECT req FROM g WHERE grid IS NULL)")
def batch_resolve(spark, sf):
    return T.whole_batches(grid_resolve(spark, sf), "req", "grid")


@query(f"WITH {ONCE}, a AS (SELECT req, pos, pk FROM o WHERE pk % 7 <> 0), b AS (SELECT req, pos, sk FROM o WHERE sk % 9 <> 0), n AS (SELECT req, count(*) FILTER (pk % 7 <> 0) <> count(*) FILTER (sk % 9 <> 0) AS bad FROM o GROUP BY 1) SELECT req, pos, pk, sk, CASE WHEN bad THEN 'length mismatch' END AS error FROM a FULL JOIN b USING (req, pos) JOIN n USING (req)")
def zip_descriptors(spark, sf):
    rows = _once(spark, sf)
    return T.zipped(rows.where("pk % 7 <> 0").select("req", "pos", "pk"), rows.where("sk % 9 <> 0").select("req", "pos", "sk"), "req", "pos")


@query(f"WITH {ONCE}, s AS (SELECT req, pos, pk % 11 = 0 AS other FROM o WHERE sk % 2 = 0) SELECT req, pos FROM s WHERE req NOT IN (SELECT req FROM s WHERE other)")
def scheduled_features(spark, sf):
    rows = _once(spark, sf)
    features = rows.select("req", "pos", F.when(F.col("pk") % 11 == 0, "video").otherwise("image").alias("modality"))
    ids = rows.where("sk % 2 = 0").select("req", "pos").union(rows.select("req", (F.col("pos") + 1000).alias("pos")))
    return T.scheduled_features(ids, features, "req", "pos").select("req", "pos")


@query(f"""WITH {ONCE}, f AS (SELECT req, pos, pk % 3 <> 0 AND pk % 3 <> 1 AS remote, CASE sk % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 2 END AS n, sk % 10 = 3 AS synthetic FROM o)
SELECT req, pos, remote AND (n IS NULL OR n = 0 OR synthetic) AS filled, CASE WHEN remote AND (n IS NULL OR n = 0 OR synthetic) THEN 12 ELSE n END::INT AS n, CASE WHEN remote AND (n IS NULL OR n = 0 OR synthetic) THEN 0.0 WHEN n = 2 THEN 3.0 ELSE 0.0 END::DOUBLE AS total FROM f""")
def fill_placeholders(spark, sf):
    rows = _once(spark, sf).select("req", "pos", F.when(F.col("pk") % 3 != 0, (F.col("pk") % 3).cast("int")).alias("producer_rank"), (F.col("sk") % 10 == 3).alias("synthetic"),
        F.when(F.col("sk") % 4 == 0, None).when(F.col("sk") % 4 == 1, T.placeholder(F.lit(1), F.lit(1), F.lit(1), F.lit(1), True)).otherwise(F.expr("array(float(1), float(2))")).alias("data"),
        F.lit(1).alias("t"), F.lit(2).alias("gh"), F.lit(3).alias("gw"), F.lit(2).alias("width"))
    out = T.fill_remote(rows, 1)
    total = F.coalesce(F.aggregate("data", F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    return out.select("req", "pos", "filled", F.when(F.col("data").isNotNull(), F.size("data")).alias("n"), total.alias("total"))


@query("WITH d AS (SELECT conv_id, len(text) AS n FROM conversations WHERE text IS NOT NULL), g AS (SELECT conv_id, list(n ORDER BY n) AS a FROM d GROUP BY 1) SELECT conv_id, len(a) * 2 AS n_rows, list_sum(a)::BIGINT * 3 AS total FROM g")
def flatten_embeddings(spark, sf):
    n = F.length("text").cast("long")
    rows = Fixture("c", "conversations", {"conv_id": "conv_id", "text": "text"}, "text IS NOT NULL")(spark, sf)
    nested = rows.groupBy("conv_id").agg(F.collect_list(F.array(F.array(n), F.array(n, n))).alias("e"))
    flat = nested.select("conv_id", T.flat_rows(F.col("e")).alias("r"))
    return flat.select("conv_id", F.size("r").alias("n_rows"), F.aggregate(F.flatten("r"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"""WITH {ONCE}, m AS (SELECT req, pos, pk % 2 = 0 AS mask, count(*) FILTER (pk % 2 = 0) OVER (PARTITION BY req ORDER BY pos) AS k FROM o),
e AS (SELECT req, row_number() OVER (PARTITION BY req ORDER BY sk, pos) AS k, sk FROM o WHERE pk % 2 = 0 AND NOT (req % 5 = 0 AND pos = 2)), n AS (SELECT req, count(*) FILTER (pk % 2 = 0) <> count(*) FILTER (pk % 2 = 0 AND NOT (req % 5 = 0 AND pos = 2)) AS bad FROM o GROUP BY 1)
SELECT m.req, m.pos, mask, CASE WHEN NOT bad THEN CASE WHEN mask THEN e.sk ELSE 0 END END AS merged, CASE WHEN bad THEN 'embedding count mismatch' END AS error FROM m JOIN n USING (req) LEFT JOIN e ON e.req = m.req AND e.k = m.k AND mask""")
def scatter_checked(spark, sf):
    rows = _once(spark, sf)
    k = F.expr("row_number() OVER (PARTITION BY req ORDER BY sk, pos)").cast("long")
    made = rows.where("pk % 2 = 0 and not (req % 5 = 0 and pos = 2)").select("req", k.alias("k"), "sk")
    return T.scatter(rows.select("req", "pos", (F.col("pk") % 2 == 0).alias("mask")), made, "req", "pos", "mask", "sk", F.lit(0).cast("long"))


@query(f"""WITH {ONCE}, i AS (SELECT req, pos AS idx, pk % 3 AS rank, row_number() OVER (PARTITION BY req, pk % 3 ORDER BY sk, pos) AS place, 1 + sk % 2 AS n FROM o),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY req, rank ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM i),
x AS (SELECT req, idx, rank, unnest(range(n)) AS i, start FROM s) SELECT req, idx, i, CASE WHEN start + i < 3 THEN (req * 100 + rank * 10 + start + i)::BIGINT END AS value, CASE WHEN start + i >= 3 THEN 'hole in gathered rows' END AS error FROM x""")
def gather_values(spark, sf):
    items = _once(spark, sf).selectExpr("req", "pos AS idx", "pk % 3 AS rank", "CAST(row_number() OVER (PARTITION BY req, pk % 3 ORDER BY sk, pos) AS BIGINT) AS place", "1 + sk % 2 AS rows")
    ranks = items.select("req", "rank").distinct()
    blocks = ranks.withColumn("row", F.explode(F.expr("sequence(0L, 2L)"))).withColumn("value", F.expr("req * 100 + rank * 10 + row"))
    return T.gathered(blocks, items, "req")


@query("""WITH c AS (SELECT o_custkey AS req, o_orderkey AS call, (o_orderkey % 3)::INT AS g FROM orders), x AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY call) AS k FROM c),
g AS (SELECT req, list(CASE WHEN call % 7 = 0 THEN 9 ELSE g END ORDER BY call) AS grids FROM c GROUP BY 1)
SELECT req, call, CASE WHEN call % 7 <> 0 AND count(*) FILTER (call % 7 = 0) OVER (PARTITION BY req ORDER BY k) = 0 THEN (k - 1)::INT END AS start FROM x""")
def context_cursor(spark, sf):
    calls = Fixture("c", "orders", {"req": "o_custkey", "call": "o_orderkey", "g": "CAST(o_orderkey % 3 AS INT)"})(spark, sf)
    shown = F.when(F.col("call") % 7 == 0, 9).otherwise(F.col("g"))
    context = calls.groupBy("req").agg(F.transform(F.sort_array(F.collect_list(F.struct("call", shown.alias("s")))), lambda x: x["s"]).alias("grids"))
    # Calls after a miss can only be told here as they all ask for one grid that the context doesn't hold again.
    missed = F.expr("count_if(call % 7 = 0) OVER (PARTITION BY req ORDER BY call)") > 0
    asked = calls.withColumn("grids", F.array(F.when(missed, F.lit(7)).otherwise(F.col("g"))))
    return T.cursor(asked.select("req", "call", "grids"), context, "req")


@query("SELECT event_id, event_id % 4 >= 1 AS dummy_ok, (event_id % 3 > 0 AND event_id % 5 = 0) AS image_only, CASE event_id % 4 WHEN 0 THEN 'no_images_captured' WHEN 1 THEN 'image_count_below_min' END AS bypass FROM events")
def request_gates(spark, sf):
    e = F.col("event_id")
    counts = F.create_map(F.lit("image"), e % 3, F.lit("audio"), F.when(e % 5 == 0, 0).otherwise(2).cast("long"))
    rows = Fixture("v", "events", {"event_id": "event_id"})(spark, sf)
    return rows.select("event_id", G.dummy_allowed(e % 4).alias("dummy_ok"), G.image_only(counts).alias("image_only"), G.bypass_reason(e % 4).alias("bypass"))


@query(f"WITH {LINES.sql}, u AS (SELECT DISTINCT req, pos FROM l WHERE pk % 2 = 0 OR sk % 3 = 0) SELECT req, count(*) AS images, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS indexes FROM u GROUP BY 1")
def captured_images(spark, sf):
    rows = LINES(spark, sf)
    a, b = rows.where("pk % 2 = 0"), rows.where("sk % 3 = 0")
    return G.captured_count(a, b, "req", "pos").join(G.index_union(a, b, "req", "pos"), "req")


@query("WITH r AS (SELECT c_custkey, c_custkey % 50 AS started FROM customer), e AS (SELECT user_id, min(event_id) AS a, max(event_id) AS z, count(*) AS n FROM events GROUP BY 1) SELECT c_custkey, a - started AS first_item_ready, z - started AS all_items_ready, coalesce(n, 0) AS items, CASE WHEN n IS NULL THEN 'no worker completions' END AS error FROM r LEFT JOIN e ON c_custkey = user_id")
def round_times(spark, sf):
    rounds = Fixture("r", "customer", {"c_custkey": "c_custkey", "started": "c_custkey % 50"})(spark, sf)
    done = Fixture("e", "events", {"c_custkey": "user_id", "at": "event_id"})(spark, sf)
    return G.round_result(done, rounds, "c_custkey", "started", "at")


@query("SELECT c_nationkey, count(*) AS workers, count(CASE WHEN c_custkey % 9 <> 0 THEN 1 END) AS bound, count(*) FILTER (c_custkey % 9 = 0) = 0 AS all_bound, count(DISTINCT CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 30 END) = count(*) AS independent FROM customer GROUP BY 1")
def affinity_summary(spark, sf):
    rows = Fixture("w", "customer", {"c_nationkey": "c_nationkey", "cpu": "CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 30 END"})(spark, sf)
    return G.affinity(rows, "c_nationkey", "cpu")


@query("WITH t AS (SELECT event_id, value AS sent, value + event_id % 10 AS first, value + event_id % 10 + event_id % 100 - 5 AS last, event_id % 7 AS n FROM events) SELECT event_id, first - sent AS ttft_ms, greatest(last - first, 0) / greatest(n - 1, 1) AS tpot_ms, last - sent AS e2e_ms FROM t")
def request_latencies(spark, sf):
    rows = Fixture("t", "events", {"event_id": "event_id", "sent": "value", "first": "value + event_id % 10", "last": "value + event_id % 10 + event_id % 100 - 5", "n": "event_id % 7"})(spark, sf)
    return G.latencies(rows, "sent", "first", "last", "n").select("event_id", "ttft_ms", "tpot_ms", "e2e_ms")


RUNS = {"transport": "event_type", "images": "CAST(user_id % 3 AS INT)", "run": "event_id % 8", "status": "CASE WHEN event_id % 10 = 0 THEN 500 ELSE 200 END", "semantic": "event_id % 4 <> 1", "ttft": "value / 2", "e2e": "value"}


@query(f"""WITH {Fixture("r", "events", RUNS).sql} SELECT transport, images, count(*) AS measured, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status = 200 AND semantic) AS semantic_ok, round(avg(ttft) FILTER (status = 200), 6) AS ttft_avg, round(avg(e2e) FILTER (status = 200), 6) AS e2e_avg,
  max(ttft) FILTER (status = 200) AS ttft_max, max(e2e) FILTER (status = 200) AS e2e_max FROM r WHERE run >= 3 GROUP BY ALL""")
def benchmark_cases(spark, sf):
    return G.benchmark_matrix(Fixture("r", "events", RUNS)(spark, sf), ["transport", "images"], 3)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def percentile_ranks(spark, sf):
    rows = Fixture("e", "events", {"event_type": "event_type", "value": "value"})(spark, sf)
    got = G.percentile(rows, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return got.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query("SELECT event_id, CASE WHEN event_id % 5 < 1 THEN 'image count must be positive' WHEN event_id % 7 = 0 THEN 'image size must be positive' WHEN event_id % 110 NOT BETWEEN 1 AND 95 THEN 'quality must be from 1 to 95' END AS error FROM events")
def argument_checks(spark, sf):
    e = F.col("event_id")
    return Fixture("v", "events", {"event_id": "event_id"})(spark, sf).select("event_id", G.argument_errors(e % 5, e % 7, F.lit(4), e % 110).alias("error"))


_KEY = "CASE event_type WHEN 'view' THEN 'source' WHEN 'click' THEN 'decode' WHEN 'purchase' THEN 'manager_cache_put_ms' WHEN 'signup' THEN 'unknown_key' ELSE 'total' END"
_TEXT = "CASE event_id % 4 WHEN 0 THEN 'n/a' ELSE CAST(event_id % 50 AS VARCHAR(20)) END"
TIMED = {"event_id": "event_id", "user_id": "user_id", "key": _KEY, "value": _TEXT}


@query(f"""WITH {Fixture("t", "events", TIMED).sql} SELECT event_id, user_id, CASE key WHEN 'source' THEN 'worker_source_ms' WHEN 'decode' THEN 'worker_decode_ms' WHEN 'total' THEN 'worker_total_ms' ELSE key END AS key, value::DOUBLE AS value FROM t WHERE key <> 'unknown_key' AND value <> 'n/a'""")
def timing_diagnostics(spark, sf):
    return P.renamed(Fixture("t", "events", TIMED)(spark, sf))


@query(f"""WITH {Fixture("t", "events", TIMED).sql} SELECT user_id, key, sum(value::DOUBLE) AS total FROM t WHERE value <> 'n/a' GROUP BY ALL""")
def diagnostic_merge(spark, sf):
    return P.summed(Fixture("t", "events", TIMED)(spark, sf), "user_id")


_JSON = "CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN '12' WHEN 2 THEN '\"text\"' WHEN 3 THEN 'null' WHEN 4 THEN '{\"a\": 1}' WHEN 5 THEN '[1, 2.5, \"x\"]' WHEN 6 THEN '1e999' ELSE '-0.25' END"


@query("""SELECT event_id, event_type AS key, CASE event_id % 8 WHEN 0 THEN 'bool' WHEN 2 THEN 'string' WHEN 5 THEN 'list' ELSE 'number' END AS kind, CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN '12.0' WHEN 2 THEN 'text' WHEN 5 THEN '["1","2.5","x"]' ELSE '-0.25' END AS text FROM events WHERE event_id % 8 NOT IN (3, 4, 6)""")
def profile_sanitize(spark, sf):
    return P.sanitized(Fixture("j", "events", {"event_id": "event_id", "key": "event_type", "json": _JSON})(spark, sf))


@query("SELECT event_id, (event_id % 3)::BIGINT AS a, (CASE WHEN event_id % 2 = 0 THEN event_id % 5 ELSE event_id % 7 END)::BIGINT AS b, (CASE WHEN event_id % 2 = 0 THEN 9 END)::BIGINT AS c FROM events")
def map_merge(spark, sf):
    e = F.col("event_id")
    left = F.create_map(F.lit("a"), e % 3, F.lit("b"), e % 7)
    right = F.when(e % 2 == 0, F.create_map(F.lit("b"), e % 5, F.lit("c"), F.lit(9).cast("long"))).otherwise(F.expr("map_from_entries(CAST(array() AS array<struct<k: string, v: bigint>>))"))
    rows = Fixture("v", "events", {"event_id": "event_id"})(spark, sf).select("event_id", P.merged(left, right).alias("m"))
    return rows.select("event_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"))


@query(f"WITH {LINES.sql} SELECT req, coalesce(sum(CASE WHEN pk % 4 <> 0 THEN pk * 4 END), 0)::BIGINT AS payload_bytes FROM l GROUP BY 1")
def payload_bytes(spark, sf):
    rows = LINES(spark, sf).withColumn("nbytes", F.when(F.col("pk") % 4 != 0, F.col("pk") * 4))
    return P.payload_bytes(rows, "req")


@query("""WITH r AS (SELECT user_id, event_id AS row, event_type AS key, value, CASE event_id % 3 WHEN 0 THEN 'READY' WHEN 1 THEN 'FAILED' ELSE 'QUEUED' END AS state FROM events), n AS (SELECT user_id, count(DISTINCT row) AS n, count(*) FILTER (state = 'READY') AS ready, count(*) FILTER (state = 'FAILED') AS failed FROM r GROUP BY 1),
g AS (SELECT user_id, key, sum(value) AS s, max(value) AS m, count(*) AS k FROM r GROUP BY ALL) SELECT user_id, key, round(s / n, 9) AS avg, CASE WHEN k < n THEN greatest(m, 0.0) ELSE m END AS max, round(s, 4) AS sum, ready, failed FROM g JOIN n USING (user_id)""")
def worker_timings(spark, sf):
    rows = Fixture("r", "events", {"user_id": "user_id", "row": "event_id", "key": "event_type", "value": "value", "state": "CASE event_id % 3 WHEN 0 THEN 'READY' WHEN 1 THEN 'FAILED' ELSE 'QUEUED' END"})(spark, sf)
    out = P.worker_summary(rows, "user_id", "state", "key", "value")
    return out.select("user_id", "key", F.round("avg", 9).alias("avg"), "max", F.round("sum", 4).alias("sum"), "ready", "failed")


@query("SELECT event_id, value AS api_prepare_total, CASE WHEN event_id % 4 > 0 THEN (event_id % 4)::DOUBLE ELSE value END AS total FROM events")
def prepare_timings(spark, sf):
    rows = Fixture("v", "events", {"event_id": "event_id", "api_prepare_total": "value"})(spark, sf)
    return rows.withColumn("total", P.prepare_total((F.col("event_id") % 4).cast("double"), F.col("api_prepare_total")))


@query("""WITH e AS (SELECT event_type AS label, event_id AS started, event_id + user_id % 9 AS ended FROM events), s AS (SELECT label, count(*) AS calls, sum(ended - started)::BIGINT AS total, max(ended - started) AS longest, min(started) AS first_start, max(ended) AS last_end, avg(ended - started) AS mean, max(ended) - min(started) AS span FROM e GROUP BY 1)
SELECT *, (row_number() OVER (ORDER BY total DESC, first_start, label))::INT AS place FROM s""")
def function_summary(spark, sf):
    rows = Fixture("e", "events", {"event_type": "event_type", "a": "event_id", "z": "event_id + user_id % 9"})(spark, sf)
    return P.ranked(P.event_summary(P.events(rows, "event_type", "a", "z")))


@query("WITH r AS (SELECT user_id % 20 AS batch, event_id AS prepare_at, event_id + user_id AS ready_at, event_id + user_id + 5 AS fetched_at, CASE WHEN event_id % 3 > 0 THEN event_id % 100 END AS nbytes FROM events WHERE user_id IS NOT NULL) SELECT batch, min(ready_at) - min(prepare_at) AS first_ready, max(ready_at) - min(prepare_at) AS all_ready, max(fetched_at) - max(ready_at) AS fetch, coalesce(sum(nbytes), 0)::BIGINT AS nbytes FROM r GROUP BY 1")
def benchmark_phases(spark, sf):
    rows = Fixture("r", "events", {"batch": "user_id % 20", "prepare_at": "event_id", "ready_at": "event_id + user_id", "fetched_at": "event_id + user_id + 5", "nbytes": "CASE WHEN event_id % 3 > 0 THEN event_id % 100 END"}, "user_id IS NOT NULL")(spark, sf)
    return P.phases(rows, "batch")


@query("WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT e.event_id, e.value / n.n AS share FROM events e JOIN n ON e.user_id IS NOT DISTINCT FROM n.user_id")
def batch_cost(spark, sf):
    rows = Fixture("v", "events", {"event_id": "event_id", "user_id": "user_id", "value": "value"})(spark, sf)
    return G.split_cost(rows, "user_id", "value").select("event_id", "share")


@query(f"WITH {LINES.sql} SELECT req, CASE WHEN count(*) FILTER (pos > 4) > 0 THEN 'planned_item_count_mismatch' WHEN count(*) FILTER (pk % 20 = 0) > 0 THEN 'missing_image_grid_thw' ELSE 'synthetic_qwen_image_path' END AS gate FROM l GROUP BY 1")
def fast_path(spark, sf):
    return G.fast_path(LINES(spark, sf), "req", F.col("pos") <= 4, F.when(F.col("pk") % 20 != 0, F.col("pk")))


@query(f"WITH {LINES.sql} SELECT req, pos FROM l WHERE (req, pos) NOT IN (SELECT (req, pos) FROM l WHERE pk % 4 = 0)")
def unprepared_images(spark, sf):
    rows = LINES(spark, sf)
    return G.unprepared(rows, rows.where("pk % 4 = 0"), ["req", "pos"])


@query(f"WITH {LINES.sql} SELECT req, count(*) AS images, CASE WHEN count(*) < 2 THEN 'image_count_below_min' END AS reason, count(*) >= 2 AS enabled FROM l GROUP BY 1")
def min_image_bypass(spark, sf):
    g = LINES(spark, sf).groupBy("req").agg(F.count("*").alias("images"))
    reason = G.bypass_reason(F.col("images"))
    return g.select("req", "images", reason.alias("reason"), reason.isNull().alias("enabled"))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_ready, count(DISTINCT event_id % 4) AS world_size, count(DISTINCT CASE WHEN event_type = 'purchase' THEN event_id % 4 END) = count(DISTINCT event_id % 4) AS all_ready FROM events GROUP BY 1")
def rank_barrier(spark, sf):
    rows = Fixture("v", "events", {"user_id": "user_id", "rank": "event_id % 4", "ready": "event_type = 'purchase'"})(spark, sf)
    return G.barrier(rows, "user_id", "rank", "ready")
