"""Queries of handles, claims, source plans and lifecycles.

The tables hold no requests, so orders stand for entries of the state table, for the handles that ask for them and for
plan rows, and events for what workers report.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import coordination as C
from loomline.operators import handles as H
from loomline.operators import relational as R
from loomline.plans.registry import Fixture, query
from loomline.streaming import lifecycle

ENTRIES = Fixture("e", "orders", {
    "cache_key": "concat('k', CAST(o_orderkey AS VARCHAR(20)))", "request_id": "concat('r', CAST(o_custkey AS VARCHAR(20)))", "idx": "CAST(o_orderkey % 4 AS INT)", "epoch": "CAST(1 + o_orderkey % 3 AS INT)",
    "state": "CASE WHEN o_orderkey % 11 = 0 THEN 'FALLBACK_CLAIMED' WHEN o_orderkey % 13 = 0 THEN 'FALLBACK_LOCAL_DONE' WHEN o_orderkey % 17 = 0 THEN 'FAILED' WHEN o_orderkey % 19 = 0 THEN 'EXPIRED' WHEN o_orderstatus = 'F' THEN 'READY' WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE 'SIDECAR_RUNNING' END",
    "claimed_by": "CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN concat('r', CAST(o_custkey AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN concat('::producer_rank=', CAST(o_orderkey % 3 AS VARCHAR(20))) ELSE '' END) END",
    "tokens": "CASE WHEN o_orderkey % 4 <> 1 THEN CAST(o_orderkey % 500 + 1 AS INT) END", "cached": "o_orderkey % 7 <> 0", "payload": "o_orderkey % 5 <> 0", "nbytes": "CAST(o_orderkey % 1000 * 4 AS BIGINT)", "signature": "concat('s', CAST(o_orderkey % 2 AS VARCHAR(20)))",
})
HANDLES = Fixture("h", "orders", {
    "pos": "o_orderkey", "request_id": "concat('r', CAST(o_custkey + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)))", "idx": "CAST(CASE WHEN o_orderkey % 31 = 0 THEN 9 ELSE o_orderkey % 4 END AS INT)",
    "cache_key": "concat(CASE WHEN o_orderkey % 29 = 0 THEN 'x' ELSE 'k' END, CAST(o_orderkey AS VARCHAR(20)))", "epoch": "CAST(1 + o_orderkey % 3 + CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS INT)",
})
ME = "concat(h.request_id, '::producer_rank=1')"
STALE = "NOT (h.request_id = e.request_id AND h.idx = e.idx AND h.epoch = e.epoch)"
JOINED = f"WITH {ENTRIES.sql}, {HANDLES.sql}, j AS (SELECT h.*, e.cache_key IS NULL AS miss, coalesce({STALE}, FALSE) AS stale, e.state AS e_state, e.tokens AS e_tokens, e.claimed_by AS e_claimed, e.epoch AS e_epoch, e.cached, e.payload, e.nbytes AS e_nbytes, {ME} AS me FROM h LEFT JOIN e ON h.cache_key = e.cache_key)"


@query(f"{JOINED} SELECT pos, request_id, idx, cache_key, epoch, CASE WHEN miss OR stale THEN 'ABSENT' ELSE e_state END AS state, CASE WHEN NOT stale THEN e_tokens END AS tokens, CASE WHEN NOT stale THEN e_claimed END AS claimed_by, CASE WHEN stale THEN 'stale_handle' END AS error FROM j")
def handle_status(spark, sf):
    return H.lookup(HANDLES(spark, sf), ENTRIES(spark, sf))


@query(f"WITH {ENTRIES.sql}, k AS (SELECT l_orderkey * 10 + l_linenumber AS pos, concat('k', CAST(l_orderkey + CASE WHEN l_linenumber = 3 THEN 10000000 ELSE 0 END AS VARCHAR(20))) AS cache_key FROM lineitem) SELECT pos, k.cache_key, coalesce(state, 'ABSENT') AS state, epoch, CASE WHEN state IS NULL THEN 'cache_key_not_found' END AS error FROM k LEFT JOIN e USING (cache_key)")
def key_status(spark, sf):
    keys = Fixture("k", "lineitem", {"pos": "l_orderkey * 10 + l_linenumber", "cache_key": "concat('k', CAST(l_orderkey + CASE WHEN l_linenumber = 3 THEN 10000000 ELSE 0 END AS VARCHAR(20)))"})
    return H.lookup_keys(keys(spark, sf), ENTRIES(spark, sf))


TAKES = "e_state IN ('QUEUED', 'SIDECAR_RUNNING', 'FAILED', 'EXPIRED', 'ABSENT')"


@query(f"""{JOINED} SELECT pos, miss OR NOT stale AND ({TAKES} OR e_state = 'FALLBACK_CLAIMED' AND coalesce(e_claimed = me, FALSE)) AS granted, CASE WHEN miss THEN 'ABSENT' WHEN NOT stale AND {TAKES} THEN 'FALLBACK_CLAIMED' ELSE e_state END AS state,
  (CASE WHEN miss THEN epoch WHEN NOT stale AND {TAKES} THEN e_epoch + 1 ELSE e_epoch END)::INT AS new_epoch, CASE WHEN miss THEN NULL WHEN NOT stale AND {TAKES} THEN me ELSE e_claimed END AS owner, CASE WHEN stale THEN 'stale_handle' END AS error FROM j""")
def fallback_claim(spark, sf):
    me = F.concat(F.col("h.request_id"), F.lit("::producer_rank=1"))
    return H.claim(HANDLES(spark, sf), ENTRIES(spark, sf), me).select("pos", "granted", "state", "new_epoch", "owner", "error")


@query(f"""{JOINED}, p AS (SELECT pos, e_state, CASE WHEN miss THEN 'entry_not_found' WHEN stale THEN 'stale_handle' WHEN coalesce(e_claimed, '') <> me THEN 'claim_mismatch' END AS error FROM j)
SELECT pos, CASE WHEN error IS NULL THEN 'FALLBACK_LOCAL_DONE' ELSE e_state END AS new_state, error FROM p""")
def publish_local_result(spark, sf):
    me = F.concat(F.col("h.request_id"), F.lit("::producer_rank=1"))
    return H.publish(HANDLES(spark, sf), ENTRIES(spark, sf), me).select("pos", "new_state", "error")


@query(f"""{JOINED} SELECT pos, CASE WHEN NOT miss AND NOT stale AND (e_state = 'READY' AND cached OR e_state = 'FALLBACK_LOCAL_DONE' AND payload) THEN e_nbytes END AS nbytes,
  CASE WHEN NOT miss AND NOT stale AND e_state = 'READY' AND NOT cached THEN 'EXPIRED' ELSE e_state END AS new_state FROM j""")
def fetch_ready(spark, sf):
    return H.fetch(HANDLES(spark, sf), ENTRIES(spark, sf)).select("pos", "nbytes", "new_state")


@query(f"{JOINED}, s AS (SELECT request_id, CASE WHEN miss OR stale THEN 'ABSENT' ELSE e_state END AS state, CASE WHEN NOT stale THEN e_tokens END AS tokens FROM j), d AS (SELECT *, state NOT IN ('ABSENT', 'QUEUED', 'SIDECAR_RUNNING') AS done FROM s) SELECT request_id, bool_and(done OR tokens IS NOT NULL) AS metadata_known, bool_and(done) AS all_final, count(*) FILTER (NOT done) AS open FROM d GROUP BY 1")
def wait_for_metadata(spark, sf):
    return H.wait_done(H.lookup(HANDLES(spark, sf), ENTRIES(spark, sf)))


@query(f"""WITH {ENTRIES.sql}, r AS (SELECT *, CASE WHEN state = 'READY' AND NOT cached THEN 'EXPIRED' ELSE state END AS s FROM e)
SELECT count(*) FILTER (s = 'QUEUED') AS queued, count(*) FILTER (s = 'SIDECAR_RUNNING') AS running, count(*) FILTER (s = 'READY') AS ready, count(*) FILTER (s = 'FAILED') AS failed, count(*) FILTER (s = 'EXPIRED') AS expired,
  count(*) FILTER (cached) AS cache_items, coalesce(sum(nbytes) FILTER (cached), 0)::BIGINT AS cache_bytes, count(*) FILTER (s IN ('QUEUED', 'SIDECAR_RUNNING')) AS in_flight FROM r""")
def manager_stats(spark, sf):
    return H.stats(H.refresh(ENTRIES(spark, sf)))


@query(f"WITH {ENTRIES.sql}, q AS (SELECT l_orderkey * 10 + l_linenumber AS pos, concat('k', CAST(l_orderkey + l_linenumber % 2 AS VARCHAR(20))) AS cache_key FROM lineitem) SELECT min(pos) AS pos, cache_key FROM q WHERE cache_key NOT IN (SELECT cache_key FROM e WHERE cached OR state IN ('QUEUED', 'SIDECAR_RUNNING', 'READY')) GROUP BY cache_key")
def prepare_submissions(spark, sf):
    asked = Fixture("q", "lineitem", {"pos": "l_orderkey * 10 + l_linenumber", "cache_key": "concat('k', CAST(l_orderkey + l_linenumber % 2 AS VARCHAR(20)))"})
    return H.new_work(asked(spark, sf), ENTRIES(spark, sf))


DESCRIPTORS = Fixture("d", "orders", {"request_id": "concat('r', CAST(o_custkey % 400 AS VARCHAR(20)))", "idx": "CAST(o_orderkey AS INT)", "cache_key": "concat('k', CAST(o_orderkey AS VARCHAR(20)))", "signature": "concat('s', CAST(o_orderkey % 2 AS VARCHAR(20)))"})
RANK_SQL = "CASE WHEN contains(claimed_by, '::producer_rank=') THEN split_part(claimed_by, '::producer_rank=', 2)::INT END"


#: Requests of two images, so that there are some of which all images are ready or have an owner.
PAIRS = Fixture("d", "orders", DESCRIPTORS.columns | {"request_id": "concat('r', CAST(o_orderkey - o_orderkey % 2 AS VARCHAR(20)))"})


@query(f"""WITH {ENTRIES.sql}, {PAIRS.sql}, j AS (SELECT d.request_id, d.idx, d.cache_key, e.state, e.epoch, CASE WHEN state IN ('FALLBACK_CLAIMED', 'FALLBACK_LOCAL_DONE') THEN {RANK_SQL} END AS producer_rank FROM d LEFT JOIN e USING (cache_key)),
u AS (SELECT request_id FROM j WHERE coalesce(state, '') <> 'READY' AND producer_rank IS NULL)
SELECT request_id, idx, CASE WHEN state = 'READY' THEN 'USE_SIDECAR' ELSE 'FALLBACK' END AS decision, producer_rank, state, CASE WHEN state = 'READY' THEN 'ready' ELSE 'fallback' END || '_observed_from_manager' AS reason, cache_key, epoch FROM j WHERE request_id NOT IN (SELECT request_id FROM u)""")
def observe_plan(spark, sf):
    return C.observe(PAIRS(spark, sf), ENTRIES(spark, sf))


@query(f"WITH {DESCRIPTORS.sql} SELECT request_id, idx, 'FALLBACK' AS decision, 2::INT AS producer_rank, 'manager_unavailable_fail_open' AS reason FROM d")
def fail_open_plan(spark, sf):
    return C.fail_open(DESCRIPTORS(spark, sf), 2)


PLAN = Fixture("p", "orders", {
    "request_id": "concat('r', CAST(o_custkey % 400 AS VARCHAR(20)))", "idx": "CAST(o_orderkey AS INT)", "decision": "CASE WHEN o_orderkey % 3 = 0 THEN 'USE_SIDECAR' ELSE 'FALLBACK' END",
    "producer_rank": "CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey % 4 AS INT) END", "state": "CASE WHEN o_orderkey % 10 = 9 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'READY' ELSE 'FALLBACK_CLAIMED' END",
    "reason": "CASE WHEN o_orderkey % 3 = 0 THEN 'ready_before_fallback' WHEN o_orderkey % 9 <> 4 THEN 'fallback_claim_granted' END", "cache_key": "CASE WHEN o_orderkey % 5 <> 2 THEN concat('k', CAST(o_orderkey AS VARCHAR(20))) END", "epoch": "CAST(1 + o_orderkey % 3 AS INT)",
    "near_ms": "CAST(o_custkey % 400 % 7 AS DOUBLE)", "running_ms": "CAST(o_custkey % 400 % 5 AS DOUBLE)",
})


@query(f"""WITH {PLAN.sql}, {DESCRIPTORS.sql}, j AS (SELECT p.request_id, p.idx, decision, producer_rank, d.idx IS NULL AND decision <> 'USE_SIDECAR' AS lost FROM p LEFT JOIN d ON p.request_id = d.request_id AND p.idx = d.idx)
SELECT request_id, idx, CASE WHEN lost THEN NULL WHEN decision = 'USE_SIDECAR' THEN 'fetch_ready' WHEN coalesce(producer_rank, 1) <> 1 THEN 'fetch_remote' ELSE 'local_fallback' END AS step, CASE WHEN lost THEN 'fallback descriptor missing for media index ' || idx END AS error FROM j""")
def fetch_by_plan(spark, sf):
    return C.route(PLAN(spark, sf), DESCRIPTORS(spark, sf), 1).select("request_id", "idx", "step", "error")


@query(f"""WITH {PLAN.sql}, {DESCRIPTORS.sql}, {ENTRIES.sql}, j AS (SELECT p.request_id, p.idx, decision = 'USE_SIDECAR' AS side, e.nbytes FROM p JOIN d ON p.request_id = d.request_id AND p.idx = d.idx LEFT JOIN e ON p.cache_key = e.cache_key AND p.epoch = e.epoch AND e.state = 'READY' AND e.cached)
SELECT request_id, idx, CASE WHEN NOT side THEN 'local' WHEN nbytes IS NOT NULL THEN 'sidecar' END AS step, CASE WHEN side THEN nbytes END AS nbytes, CASE WHEN side AND nbytes IS NULL THEN 'sidecar artifact missing during degraded fetch for media index ' || idx END AS error FROM j""")
def degraded_batch(spark, sf):
    return C.degraded(PLAN(spark, sf), DESCRIPTORS(spark, sf), ENTRIES(spark, sf))


@query("SELECT event_id, user_id % 3 + 1 > 1 AND event_id % 4 <> 0 AND event_type IN ('click', 'error') AS degrade FROM events")
def degrade_predicate(spark, sf):
    rows = Fixture("v", "events", {"event_id": "event_id", "world": "user_id % 3 + 1", "rank": "event_id % 4", "message": "CASE event_type WHEN 'click' THEN 'x: remote fallback artifact missing for 3' WHEN 'error' THEN 'remote fallback artifact unavailable' WHEN 'view' THEN 'remote fallback artifact late' ELSE 'other' END"})
    return rows(spark, sf).select("event_id", C.may_degrade(F.col("world"), F.col("rank"), F.lit(0), F.col("message")).alias("degrade"))


@query(f"WITH {PLAN.sql}, a AS (SELECT request_id, idx, idx % 100 AS nbytes FROM p WHERE idx % 2 = 1) SELECT a.request_id, a.idx, nbytes, cache_key, epoch FROM a JOIN p USING (request_id, idx) WHERE producer_rank = 1 AND cache_key IS NOT NULL")
def publish_own_artifacts(spark, sf):
    plan = PLAN(spark, sf)
    return C.to_publish(plan, plan.where("idx % 2 = 1").select("request_id", "idx", (F.col("idx") % 100).alias("nbytes")), 1)


FEATURES = Fixture("f", "orders", {"req": "o_custkey % 400", "pos": "o_orderkey", "modality": "CASE WHEN o_orderkey % 9 = 0 THEN 'audio' ELSE 'image' END", "identifier": "CASE WHEN o_orderkey % 15 = 0 THEN '' WHEN o_orderkey % 41 = 0 THEN 'gone' ELSE concat('k', CAST(o_orderkey AS VARCHAR(20))) END"})


@query(f"""WITH {FEATURES.sql}, {ENTRIES.sql}, j AS (SELECT req, pos, e.request_id, e.signature, e.epoch FROM f LEFT JOIN e ON identifier = cache_key WHERE modality = 'image' AND identifier <> '')
SELECT req, arg_min(request_id, pos) AS request_id, arg_min(signature, pos) AS signature, count(*) AS prepared_image_count, 'reconstructed_from_manager_lookup' AS reason FROM j GROUP BY req HAVING bool_and(epoch IS NOT NULL)""")
def plan_reconstruction(spark, sf):
    return C.rebuild(FEATURES(spark, sf), ENTRIES(spark, sf))


@query(f"""WITH {PLAN.sql} SELECT request_id, count(*) AS entry_count, count(*) FILTER (decision = 'USE_SIDECAR') AS use_sidecar, count(*) FILTER (decision = 'FALLBACK') AS fallback, count(*) FILTER (decision = 'FALLBACK' AND coalesce(producer_rank, 1) = 1) AS local_fallback,
  count(*) FILTER (decision = 'FALLBACK' AND producer_rank <> 1) AS remote_fallback, max(near_ms) AS near_ready_wait_ms, max(running_ms) AS running_ready_wait_ms, max(near_ms) + max(running_ms) AS reported_wait_ms FROM p GROUP BY 1""")
def plan_wait_diagnostics(spark, sf):
    return C.diagnostics(PLAN(spark, sf), 1, "near_ms", "running_ms")


@query(f"WITH {PLAN.sql}, n AS (SELECT request_id, 'source_plan_state_' || coalesce(lower(state), 'none') AS name FROM p UNION ALL SELECT request_id, 'source_plan_reason_' || coalesce(reason, 'none') FROM p) SELECT request_id, name, count(*) AS n FROM n GROUP BY ALL")
def plan_counts(spark, sf):
    return C.counts_by(PLAN(spark, sf), "state", "reason")


@query(f"WITH {PLAN.sql} SELECT request_id, string_agg(idx || ':' || decision || ':' || coalesce(state, 'none') || ':' || coalesce(reason, 'none') || ':rank=' || coalesce(producer_rank::VARCHAR, '-'), ',' ORDER BY idx) AS debug FROM p GROUP BY 1")
def plan_debug(spark, sf):
    return C.debug(PLAN(spark, sf))


@query(f"WITH {PLAN.sql} SELECT request_id, idx, CASE WHEN state = 'READY' THEN 'USE_SIDECAR' ELSE 'FALLBACK' END AS new_decision, CASE WHEN coalesce(state, '') <> 'READY' THEN 1::INT END AS new_rank, CASE WHEN state = 'READY' THEN 'ready_before_fallback' ELSE 'preview_requires_fallback' END AS new_reason FROM p")
def preview_plan(spark, sf):
    made = R.source_plan(PLAN(spark, sf).select("request_id", "idx", "state"), 1, claim=False)
    return made.select("request_id", "idx", F.col("decision").alias("new_decision"), F.col("producer_rank").alias("new_rank"), F.col("reason").alias("new_reason"))


EVENTS = Fixture("v", "events", {
    "key": "coalesce(user_id, -1)", "seq": "event_id", "event": "CASE WHEN event_id % 17 = 0 THEN 'claim' WHEN event_id % 19 = 0 THEN 'publish' WHEN event_id % 29 = 0 THEN 'done' WHEN event_id % 13 = 0 THEN 'fetch' WHEN event_id % 31 = 0 THEN 'evict' WHEN event_id % 11 = 0 THEN 'prepare' ELSE CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'probed' WHEN 'purchase' THEN 'ready' WHEN 'signup' THEN 'ready_put_done' ELSE 'failed' END END",
    "epoch": "CAST(1 + event_id % 2 AS INT)", "request": "CASE WHEN event_id % 7 = 0 THEN 'q' ELSE 'r' END", "idx": "CAST(event_id % 9 / 8 AS INT)", "claimer": "CASE WHEN event_id % 3 <> 0 THEN concat('c', CAST(event_id % 2 AS VARCHAR(20))) END",
    "item": "CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 100 AS INT) END", "t_probe": "CASE WHEN event_id % 4 = 0 THEN value END", "t_put": "CASE WHEN event_id % 6 = 0 THEN value END", "ok": "event_id % 10 <> 3", "error": "CASE WHEN event_id % 2 = 0 THEN 'decode' END", "worker": "CAST(event_id % 8 AS INT)",
})
_COLUMNS = ", ".join(EVENTS.columns)
#: A key's first event is a prepare of request r, image 0.
FIRST = "SELECT key, -1 AS seq, 'prepare' AS event, NULL AS epoch, 'r' AS request, 0 AS idx, NULL AS claimer, NULL AS item, NULL AS t_probe, NULL AS t_put, NULL AS ok, NULL AS error, 0 AS worker FROM v GROUP BY key"
#: The machine in its own words, apart from the operator's rules: what an event is to its key's entry, then each field.
_FLAGS = """SELECT *, event = 'prepare' AND coalesce(state NOT IN ('QUEUED', 'SIDECAR_RUNNING', 'READY'), TRUE) AS opens, event IN ('ready', 'failed') AND state IS NOT NULL AS lands,
  event = 'started' AND fits AND state = 'QUEUED' AS starts, event = 'probed' AND fits AS probes, event = 'ready_put_done' AND fits AS puts,
  event = 'ready' AND fits AND ok AND state <> 'FALLBACK_CLAIMED' AS readies, event = 'failed' AND fits AND state <> 'FALLBACK_CLAIMED' AS fails,
  event = 'claim' AND own AND state NOT IN ('READY', 'FALLBACK_CLAIMED', 'FALLBACK_LOCAL_DONE') AS claims, event = 'claim' AND (state IS NULL OR own AND mine AND state = 'FALLBACK_CLAIMED') AS grants,
  event = 'publish' AND own AND mine AS publishes, event = 'done' AND mine AND state = 'FALLBACK_CLAIMED' AS ends, event = 'evict' AND cached AS evicts,
  event = 'fetch' AND state = 'READY' AND NOT cached AS misses, event = 'fetch' AND (state = 'READY' AND cached OR state = 'FALLBACK_LOCAL_DONE' AND payload) AS reads
FROM (SELECT f.*, x.event, x.ok, x.claimer, x.request AS xrequest, x.idx AS xidx, x.item AS xitem, x.t_probe AS xprobe, x.t_put AS xput, x.error AS xerror, x.worker AS xworker,
  coalesce(f.state IS NOT NULL AND x.epoch = f.epoch, FALSE) AS fits, coalesce(f.state IS NOT NULL AND (x.epoch, x.request, x.idx) = (f.epoch, f.request, f.idx), FALSE) AS own, coalesce(f.claimed_by = x.claimer, FALSE) AS mine
  FROM f JOIN x ON x.key = f.key AND x.k = f.k + 1)"""
_NEXT = """SELECT key, k + 1 AS k,
  CASE WHEN opens AND cached OR readies THEN 'READY' WHEN opens THEN 'QUEUED' WHEN starts THEN 'SIDECAR_RUNNING' WHEN fails THEN 'FAILED' WHEN claims THEN 'FALLBACK_CLAIMED' WHEN publishes OR ends THEN 'FALLBACK_LOCAL_DONE' WHEN misses THEN 'EXPIRED' ELSE state END AS state,
  epoch + coalesce(opens OR claims, FALSE)::INT AS epoch, CASE WHEN event = 'prepare' THEN xrequest ELSE request END AS request, CASE WHEN event = 'prepare' THEN xidx ELSE idx END AS idx,
  CASE WHEN claims THEN claimer WHEN NOT opens THEN claimed_by END AS claimed_by, CASE WHEN probes OR readies THEN coalesce(xitem, item) WHEN cached OR NOT opens THEN item END AS item,
  CASE WHEN fails OR probes AND xput IS NOT NULL THEN xprobe WHEN probes OR puts THEN coalesce(xprobe, t_probe) WHEN cached OR NOT opens THEN t_probe END AS t_probe,
  CASE WHEN fails OR probes AND xprobe IS NOT NULL THEN xput WHEN probes OR puts THEN coalesce(xput, t_put) WHEN cached OR NOT opens THEN t_put END AS t_put,
  CASE WHEN fails THEN xerror WHEN opens OR readies THEN NULL ELSE error END AS error, CASE WHEN opens AND NOT cached THEN xworker ELSE worker END AS worker,
  CASE WHEN opens AND NOT cached THEN TRUE WHEN lands THEN FALSE ELSE in_flight END AS in_flight, CASE WHEN readies THEN TRUE WHEN evicts THEN FALSE ELSE cached END AS cached,
  CASE WHEN publishes THEN TRUE WHEN opens OR claims THEN FALSE ELSE payload END AS payload, n_applied + counts::BIGINT AS n_applied, n_dropped + (NOT counts)::BIGINT AS n_dropped
FROM (SELECT *, coalesce(event = 'prepare' OR starts OR probes OR puts OR readies OR fails OR claims OR grants OR publishes OR ends OR evicts OR reads, FALSE) AS counts FROM z)"""


@query(f"""WITH RECURSIVE {EVENTS.sql.replace("event_id % 9 / 8", "event_id % 9 // 8")}, w AS (SELECT {_COLUMNS} FROM v UNION ALL {FIRST}), x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM w),
f AS (SELECT DISTINCT key, 0::BIGINT AS k, NULL::VARCHAR AS state, 0 AS epoch, NULL::VARCHAR AS request, NULL::INT AS idx, NULL::VARCHAR AS claimed_by, NULL::INT AS item, NULL::DOUBLE AS t_probe, NULL::DOUBLE AS t_put,
  NULL::VARCHAR AS error, NULL::INT AS worker, FALSE AS in_flight, FALSE AS cached, FALSE AS payload, 0::BIGINT AS n_applied, 0::BIGINT AS n_dropped FROM x UNION ALL
  (WITH z AS ({_FLAGS}) {_NEXT}))
SELECT * EXCLUDE (k) REPLACE (coalesce(state, 'ABSENT') AS state) FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1""")
def epoch_state_machine(spark, sf):
    rows = EVENTS(spark, sf)
    first = rows.groupBy("key").agg(F.lit(-1).cast("long").alias("seq"))
    fixed = {"event": F.lit("prepare"), "request": F.lit("r"), "idx": F.lit(0), "worker": F.lit(0)}
    first = first.select("key", "seq", *(fixed.get(c, F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in lifecycle.EVENTS.split(", ")[2:])))
    return lifecycle.fold(first.unionByName(rows))


@query("""WITH RECURSIVE x AS (SELECT user_id % 40 AS grp, event_id AS seq, event_id % 3 < 2 AS submit, event_id % 4 AS w, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS k FROM events WHERE user_id IS NOT NULL),
f AS (SELECT DISTINCT grp, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::INT AS worker, [0, 0, 0, 0] AS loads FROM x UNION ALL
  SELECT f.grp, x.k, CASE WHEN submit THEN x.seq END, CASE WHEN submit THEN list_position(loads, list_min(loads)) - 1 END,
    list_transform(range(1, 5), lambda i: CASE WHEN submit THEN loads[i] + (i = list_position(loads, list_min(loads)))::INT WHEN i = w + 1 THEN greatest(loads[i] - 1, 0) ELSE loads[i] END)
  FROM f JOIN x ON x.grp = f.grp AND x.k = f.k + 1)
SELECT grp, seq, worker::INT AS worker FROM f WHERE seq IS NOT NULL""")
def least_loaded_worker(spark, sf):
    rows = Fixture("x", "events", {"grp": "user_id % 40", "seq": "event_id", "kind": "CASE WHEN event_id % 3 < 2 THEN 'submit' ELSE 'finish' END", "worker": "event_id % 4"}, "user_id IS NOT NULL")
    return R.placement(rows(spark, sf), 4)


@query("WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) SELECT event_type, event_id FROM r WHERE k <= CASE event_type WHEN 'purchase' THEN 32 ELSE 128 END AND k <= 128")
def poll_limit(spark, sf):
    rows = Fixture("x", "events", {"event_type": "event_type", "event_id": "event_id"})(spark, sf)
    ready = F.col("event_type") == "purchase"
    return R.first_queued(rows.where(ready), "event_type", ["event_id"], 32).unionByName(R.first_queued(rows.where(~ready | F.col("event_type").isNull()), "event_type", ["event_id"], 128))
