"""The engine's queries over the standard tables, each with SQL that gives the same rows.

The tables hold no images, so sides, states and profiles are derived from their integer columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import geometry, identity, signature, tensor
from loomline.operators import features, gates
from loomline.operators import relational as R
from loomline.operators import validation
from loomline.plans.registry import QUERIES, SQL, query, table  # noqa: F401

PATCH, MERGE, LOW, HIGH = 14, 2, 56 * 56, 1280 * 28 * 28
FACTOR = PATCH * MERGE


def resize_sql(h: str, w: str, variant: str = "A") -> tuple[str, str]:
    f, low, high = f"{FACTOR}.0", f"{LOW}.0", f"{HIGH}.0"
    r = lambda x: f"(round_even(({x})::DOUBLE / {f}, 0) * {f})"
    if variant == "B":
        a, b = f"greatest({f}, {r(h)})", f"greatest({f}, {r(w)})"
        area = f"({a} * {b})"
        again = lambda x: f"greatest({f}, round_even(floor({x} * sqrt((CASE WHEN {area} < {low} THEN {low} ELSE {high} END) / greatest({area}, 1.0))) / {f}, 0) * {f})"
        return tuple(f"(CASE WHEN {area} < {low} OR {area} > {high} THEN {again(x)} ELSE {x} END)::INT" for x in (a, b))
    c = (lambda x: f"greatest({f}, {x})") if variant == "C" else (lambda x: x)
    area = f"({c(r(h))} * {c(r(w))})"
    prod = f"(({h})::DOUBLE * ({w})::DOUBLE)"
    one = lambda x: f"""(CASE WHEN greatest({h}, {w})::DOUBLE / least({h}, {w}) > 200 THEN NULL
      WHEN {area} > {high} THEN greatest({f}, floor(({x})::DOUBLE / sqrt({prod} / {high}) / {f}) * {f})
      WHEN {area} < {low} THEN {c(f"ceil(({x})::DOUBLE * sqrt({low} / {prod}) / {f}) * {f}")} ELSE {c(r(x))} END)::INT"""  # noqa: E731
    return one(h), one(w)


def tokens_sql(h: str, w: str) -> str:
    return f"greatest(1, (greatest(1, {h} // {PATCH}) * greatest(1, {w} // {PATCH})) // {MERGE * MERGE})"


ITEMS_SQL = f"""items AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS idx,
  (l_partkey * 37 % 3000 + 1)::INT AS h, (l_suppkey * 131 % 2900 + l_linenumber)::INT AS w FROM lineitem),
sized AS (SELECT l_orderkey, idx, h, w, {resize_sql("h", "w")[0]} AS rh, {resize_sql("h", "w")[1]} AS rw FROM items),
tok AS (SELECT *, CASE WHEN rh IS NOT NULL THEN {tokens_sql("rh", "rw")}::INT END AS tokens FROM sized)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Media items of requests: one row per line of an order, with sides and tokens."""
    rows = table(spark, sf, "lineitem")
    rows = R.with_index(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    h, w = (F.col("l_partkey") * 37 % 3000 + 1).cast("int"), (F.col("l_suppkey") * 131 % 2900 + F.col("l_linenumber")).cast("int")
    rows = rows.select("l_orderkey", "idx", h.alias("h"), w.alias("w"))
    rh, rw = geometry.resized(F.col("h"), F.col("w"), FACTOR, LOW, HIGH)
    rows = rows.select("*", rh.alias("rh"), rw.alias("rw"))
    t, gh, gw = geometry.grid(F.col("rh"), F.col("rw"), PATCH)
    return rows.withColumn("tokens", F.when(F.col("rh").isNotNull(), geometry.tokens(t, gh, gw, MERGE)))


@query(f"WITH {ITEMS_SQL} SELECT l_orderkey, count(*) AS image_count, sum(tokens)::BIGINT AS total_tokens, max(tokens) AS max_tokens FROM tok WHERE rh IS NOT NULL GROUP BY 1")
def request_manifest(spark, sf):
    return R.manifest(items(spark, sf).where("rh is not null"), "l_orderkey")


def _sides(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 37 % 3000 + 1).cast("int").alias("h"), (F.col("n_chars") * 13 % 2800 + 1).cast("int").alias("w"))


SIDES_SQL = "d AS (SELECT doc_id, (doc_id * 37 % 3000 + 1)::INT AS h, (n_chars * 13 % 2800 + 1)::INT AS w FROM documents)"


def _resize(variant):
    def run(spark, sf):
        h, w = geometry.resized(F.col("h"), F.col("w"), FACTOR, LOW, HIGH, variant)
        return _sides(spark, sf).select("doc_id", h.alias("rh"), w.alias("rw"))

    h, w = resize_sql("h", "w", variant)
    query(f"WITH {SIDES_SQL} SELECT doc_id, {h} AS rh, {w} AS rw FROM d", f"smart_resize_{variant.lower()}")(run)


for _v in "ABC":
    _resize(_v)


@query(f"WITH {SIDES_SQL} SELECT doc_id, h, w, {resize_sql('h', 'w')[0]} AS a_h, {resize_sql('h', 'w', 'B')[0]} AS b_h FROM d WHERE {resize_sql('h', 'w')[0]} IS DISTINCT FROM {resize_sql('h', 'w', 'B')[0]}")
def resize_disagreement(spark, sf):
    a = geometry.resized(F.col("h"), F.col("w"), FACTOR, LOW, HIGH)[0]
    b = geometry.resized(F.col("h"), F.col("w"), FACTOR, LOW, HIGH, "B")[0]
    return _sides(spark, sf).select("doc_id", "h", "w", a.alias("a_h"), b.alias("b_h")).where(~F.col("a_h").eqNullSafe(F.col("b_h")))


@query(f"""WITH {SIDES_SQL}, r AS (SELECT doc_id, {resize_sql('h', 'w', 'C')[0]} AS rh, {resize_sql('h', 'w', 'C')[1]} AS rw FROM d),
g AS (SELECT doc_id, 1 AS t, greatest(1, rh // 14)::INT AS gh, greatest(1, rw // 14)::INT AS gw FROM r WHERE rh IS NOT NULL)
SELECT doc_id, m.mode, CASE WHEN m.mode <> 'count' THEN (t * gh * gw // 4)::INT END AS tokens, CASE WHEN m.mode IN ('grid', 'shape') THEN gh END AS gh, CASE WHEN m.mode IN ('grid', 'shape') THEN gw END AS gw,
  CASE WHEN m.mode = 'shape' THEN (t * gh * gw)::INT END AS n_patches, CASE WHEN m.mode = 'shape' THEN 1176 END AS width FROM g, (VALUES ('count'), ('tokens'), ('grid'), ('shape')) m(mode)""")
def manifest_modes(spark, sf):
    h, w = geometry.resized(F.col("h"), F.col("w"), FACTOR, LOW, HIGH, "C")
    rows = _sides(spark, sf).select("doc_id", h.alias("rh"), w.alias("rw")).where("rh is not null")
    _, gh, gw = geometry.grid(F.col("rh"), F.col("rw"), PATCH)
    rows = rows.select("doc_id", gh.alias("gh"), gw.alias("gw"), F.explode(F.array(*map(F.lit, ("count", "tokens", "grid", "shape")))).alias("mode"))
    n, m = F.col("gh") * F.col("gw"), F.col("mode")
    grid = m.isin("grid", "shape")
    return rows.select("doc_id", "mode", F.when(m != "count", F.floor(n / 4).cast("int")).alias("tokens"), F.when(grid, F.col("gh")).alias("gh"), F.when(grid, F.col("gw")).alias("gw"), F.when(m == "shape", n).alias("n_patches"), F.when(m == "shape", geometry.payload_width(PATCH, 2)).alias("width"))


PATHS_SQL = "CASE WHEN page_id % 5 = 0 THEN '/data/' || page_id || '.jpg' ELSE '' END"
CANON_SQL = r"""CASE WHEN regexp_extract(url, '^([hH][tT][tT][pP][sS]?)://', 1) <> '' AND regexp_extract(url, '^[^:]*://(?:[^/?#]*@)?([^/?#:]*)', 1) <> '' THEN
  lower(regexp_extract(url, '^([^:]*)://', 1)) || '://' || lower(regexp_extract(url, '^[^:]*://(?:[^/?#]*@)?([^/?#:]*)', 1))
  || regexp_extract(url, '^[^:]*://(?:[^/?#]*@)?[^/?#:]*(:\d+)?', 1)
  || CASE WHEN regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) END
  || regexp_extract(url, '^[^:]*://[^/?#]*[^?#]*(\?[^#]+)?', 1) END"""


def _pages(spark, sf):
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/data/"), F.col("page_id").cast("string"), F.lit(".jpg"))).otherwise("")
    return table(spark, sf, "pages").select("page_id", "url", path.alias("path"))


@query(f"SELECT page_id, CASE WHEN {PATHS_SQL} <> '' THEN 'local_path' WHEN lower(url) LIKE 'data:image/%' THEN 'base64' WHEN regexp_matches(url, '^[hH][tT][tT][pP][sS]?:') THEN 'http' END AS transport FROM pages")
def infer_transport(spark, sf):
    return _pages(spark, sf).select("page_id", identity.transport(F.col("url"), F.col("path")).alias("transport"))


@query(f"SELECT page_id, {CANON_SQL} AS canonical FROM pages")
def canonical_url(spark, sf):
    return _pages(spark, sf).select("page_id", identity.canonical_http_url(F.col("url")).alias("canonical"))


@query(f"""SELECT page_id, 'http:' || ({CANON_SQL}) AS http_key, 'local_path:/p/' || page_id || '|' || page_id * 1000 || '|' || length(html) AS local_key,
  'base64:req' || page_id % 7 || ':image:' || page_id % 3 AS base64_key, 'http:' || ({CANON_SQL}) || '|sig' AS cache_key FROM pages""")
def source_keys(spark, sf):
    p, n = F.col("page_id"), F.col("page_id").cast("string")
    http = identity.http_source_key(F.col("url"))
    local = identity.local_source_key(F.concat(F.lit("/p/"), n), p * 1000, F.length("html"))
    coded = identity.base64_source_key(F.concat(F.lit("req"), (p % 7).cast("string")), p % 3)
    return table(spark, sf, "pages").select("page_id", http.alias("http_key"), local.alias("local_key"), coded.alias("base64_key"), identity.cache_key(http, F.lit("sig")).alias("cache_key"))


@query("""WITH u AS (SELECT doc_id, text, (CASE doc_id % 4 WHEN 0 THEN 'data:image/png;base64,' WHEN 1 THEN 'DATA:image/gif,' WHEN 2 THEN 'data:;x,' ELSE 'nocomma' END) || replace(to_base64(encode(coalesce(text, ''))), ',', '') AS url FROM documents)
SELECT doc_id, CASE WHEN url LIKE 'data:%' AND contains(url, ',') THEN nullif(trim(split_part(split_part(substr(url, 6), ',', 1), ';', 1)), '') END AS mime,
  CASE WHEN contains(url, ',') THEN octet_length(encode(coalesce(text, '')))::BIGINT END AS size, lower(url) LIKE 'data:image/%' AS is_data FROM u""")
def data_url_size_mime(spark, sf):
    d = table(spark, sf, "documents")
    head = F.get(F.array(*map(F.lit, ("data:image/png;base64,", "DATA:image/gif,", "data:;x,", "nocomma"))), (F.col("doc_id") % 4).cast("int"))
    url = F.concat(head, F.replace(F.replace(F.base64(F.coalesce("text", F.lit("")).cast("binary")), F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit("")))
    d = d.select("doc_id", url.alias("url"))
    u = F.col("url")
    return d.select("doc_id", identity.data_url_mime(u).alias("mime"), identity.base64_size(u).alias("size"), identity.is_data_url(u).alias("is_data"))


@query("""SELECT p_partkey, 'model=' || p_name || '|rev=main|patch=' || (p_size % 20 - 2) || '|do_resize=' || (p_partkey % 2) || '|rescale_factor=0.00392156862745098|image_mean=0.5,0.5,0.5|junk' AS sig,
  greatest(1, p_size % 20 - 2)::INT AS patch, (p_partkey % 2 = 1) AS do_resize, 1::INT AS temporal, 1.5::DOUBLE AS mean_sum, p_brand AS last_brand FROM part""")
def signature_parse_typed(spark, sf):
    p = table(spark, sf, "part")
    sig = signature.build({"model": F.col("p_name"), "rev": "main", "patch": F.col("p_size") % 20 - 2, "do_resize": (F.col("p_partkey") % 2).cast("string"), "rescale_factor": 1 / 255, "image_mean": (0.5, 0.5, 0.5)})
    p = p.withColumn("sig", F.concat(sig, F.lit("|junk")))
    m = signature.parse(F.concat(F.col("sig"), F.lit("|brand=none|brand="), F.col("p_brand")))
    p = p.withColumn("m", m)
    mean = F.aggregate(signature.three(F.col("m"), "image_mean", (0.0, 0.0, 0.0)), F.lit(0.0), lambda s, x: s + x)
    return p.select("p_partkey", "sig", signature.integer(F.col("m"), "patch", 14).alias("patch"), signature.boolean(F.col("m"), "do_resize", True).alias("do_resize"), signature.integer(F.col("m"), "temporal", 1).alias("temporal"), mean.alias("mean_sum"), F.col("m")["brand"].alias("last_brand"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 16)::INT WHEN 1 THEN 3 END AS rank, 'c_' || lower(replace(c_mktsegment, ' ', '_')) AS suffix FROM customer""")
def claimer_rank_parse(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    claimer = F.when(k % 4 == 0, identity.ranked_claimer(F.col("c_name"), k % 16)).when(k % 4 == 1, F.concat(F.col("c_name"), F.lit("::producer_rank=9::producer_rank=3"))).when(k % 4 == 2, F.concat(F.col("c_name"), F.lit("::producer_rank=-1"))).otherwise(F.col("c_name"))
    return c.select("c_custkey", identity.claimer_rank(claimer).alias("rank"), identity.diagnostic_suffix(F.concat(F.lit("--C "), F.col("c_mktsegment"), F.lit("!"))).alias("suffix"))


@query("""SELECT s_suppkey, list_sort(list_distinct(range(s_suppkey % 5, s_suppkey % 5 + 3) || [s_suppkey % 11] || range(20, 23)))::VARCHAR AS cpus, len(list_distinct(range(s_suppkey % 5, s_suppkey % 5 + 3) || [s_suppkey % 11] || range(20, 23)))::INT AS n FROM supplier""")
def cpu_set_parse(spark, sf):
    s = table(spark, sf, "supplier")
    a = (F.col("s_suppkey") % 5).cast("string")
    text = F.concat(a, F.lit("-"), (F.col("s_suppkey") % 5 + 2).cast("string"), F.lit(", junk, "), (F.col("s_suppkey") % 11).cast("string"), F.lit(",22-20,"))
    ids = identity.cpu_set(text)
    return s.select("s_suppkey", F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("cpus"), F.size(ids).alias("n"))


@query("""SELECT doc_id, CASE WHEN n_chars > 4000 THEN 'encoded_bytes' WHEN (doc_id % 1300 + 1) * (n_chars % 900 + 1) > 600000 THEN 'pixels_per_image' WHEN (doc_id % 1300 + 1) * (n_chars % 900 + 1) * (1 + doc_id % 4) > 900000 THEN 'decoded_bytes' END AS error_code FROM documents""")
def ingress_quarantine(spark, sf):
    d = table(spark, sf, "documents")
    error = validation.limits_error(F.col("n_chars"), F.col("doc_id") % 1300 + 1, F.col("n_chars") % 900 + 1, 1 + F.col("doc_id") % 4, 4000, 600_000, 900_000)
    return d.select("doc_id", error.alias("error_code"))


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT l_orderkey, idx, 'cap' AS origin, NULL::INT AS h FROM tok WHERE idx % 3 <> 1), n AS (SELECT l_orderkey, idx, 'norm' AS origin, h FROM tok WHERE idx % 3 <> 2)
SELECT l_orderkey, idx, coalesce(c.origin, n.origin) AS origin, coalesce(c.h, n.h) AS h FROM n FULL JOIN c USING (l_orderkey, idx)""")
def descriptor_merge(spark, sf):
    rows = items(spark, sf)
    captured = rows.where("idx % 3 <> 1").select("l_orderkey", "idx", F.lit("cap").alias("origin"), F.lit(None).cast("int").alias("h"))
    known = rows.where("idx % 3 <> 2").select("l_orderkey", "idx", F.lit("norm").alias("origin"), "h")
    return R.coalesce_full(known, captured, ["l_orderkey", "idx"], ["origin", "h"])


@query(f"""WITH {ITEMS_SQL} SELECT l_orderkey, idx, CASE WHEN idx % 2 = 0 THEN tokens ELSE tokens + 1 END AS tokens FROM tok WHERE (idx % 2 = 0 OR idx % 3 = 0) AND tokens IS NOT NULL""")
def plan_merge_setdefault(spark, sf):
    rows = items(spark, sf)
    worker = rows.where("idx % 2 = 0").select("l_orderkey", "idx", "tokens")
    planner = rows.where("idx % 3 = 0").select("l_orderkey", "idx", (F.col("tokens") + 1).alias("tokens"))
    return R.set_default(rows.select("l_orderkey", "idx"), worker, planner, ["l_orderkey", "idx"], "tokens")


@query("""WITH r AS (SELECT c_custkey, o_orderkey, o_orderstatus FROM customer JOIN orders ON c_custkey = o_custkey)
SELECT c_custkey, o_orderkey FROM r WHERE c_custkey NOT IN (SELECT c_custkey FROM r WHERE o_orderstatus = 'P')""")
def all_match_gate(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    rows = c.join(o, c.c_custkey == o.o_custkey).select("c_custkey", "o_orderkey", "o_orderstatus")
    return R.all_match(rows, "c_custkey", F.col("o_orderstatus") != "P").select("c_custkey", "o_orderkey")


STATE = {"view": "QUEUED", "click": "SIDECAR_RUNNING", "purchase": "READY", "error": "FAILED", "signup": "EXPIRED"}
STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE.items()) + " END"


def _states(spark, sf):
    e = table(spark, sf, "events")
    state = F.lit(None).cast("string")
    for k, v in STATE.items():
        state = F.when(F.col("event_type") == k, v).otherwise(state)
    return e.withColumn("state", state)


@query(f"""SELECT count(*) FILTER (s = 'QUEUED') AS queued, count(*) FILTER (s = 'SIDECAR_RUNNING') AS running, count(*) FILTER (s = 'READY') AS ready, count(*) FILTER (s = 'FAILED') AS failed, count(*) FILTER (s = 'EXPIRED') AS expired FROM (SELECT {STATE_SQL} AS s FROM events)""")
def state_counts(spark, sf):
    names = {"queued": "QUEUED", "running": "SIDECAR_RUNNING", "ready": "READY", "failed": "FAILED", "expired": "EXPIRED"}
    return _states(spark, sf).agg(*[F.count_if(F.col("state") == s).alias(n) for n, s in names.items()])


MS_SQL = "(epoch_us(ts) // 1000)"


def _ms():
    return F.unix_millis(F.col("ts").cast("timestamp"))


@query(f"""SELECT event_type AS label, count(*) AS calls, round(sum(value), 3) AS total, max(value) AS longest, min({MS_SQL}) AS first_start, max({MS_SQL}) AS last_end, round(avg(value), 6) AS mean, max({MS_SQL}) - min({MS_SQL}) AS span FROM events GROUP BY 1""")
def event_summary(spark, sf):
    ms = _ms()
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 3).alias("total"), F.max("value").alias("longest"), F.min(ms).alias("first_start"), F.max(ms).alias("last_end"), F.round(F.avg("value"), 6).alias("mean"), (F.max(ms) - F.min(ms)).alias("span"))


@query("""SELECT event_type, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def percentiles(spark, sf):
    e = table(spark, sf, "events")
    points = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    plain = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    ranked = gates.percentile(e, "event_type", "value", points)
    return plain.join(ranked.select("event_type", *(F.round(c, 6).alias(c) for c in points)), "event_type", "left")


@query("""WITH c AS (SELECT user_id, event_id, event_type AS key, max(value) AS v FROM events GROUP BY ALL), r AS (SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY 1),
g AS (SELECT c.user_id, key, sum(v) AS s, max(v) AS m, count(*) AS k, any_value(n) AS n FROM c JOIN r USING (user_id) GROUP BY ALL)
SELECT user_id, key, round(s / n, 6) AS avg, CASE WHEN k < n THEN greatest(m, 0.0) ELSE m END AS max, round(s, 4) AS sum FROM g""")
def sparse_map_summary(spark, sf):
    rows = table(spark, sf, "events").withColumnRenamed("event_type", "key")
    out = R.sparse_summary(rows, "user_id", "event_id", "key", "value")
    return out.select("user_id", "key", F.round("avg", 6).alias("avg"), "max", F.round("sum", 4).alias("sum"))


@query(f"""WITH RECURSIVE {ITEMS_SQL}, s AS (SELECT l_orderkey, idx, coalesce(tokens, 0)::BIGINT AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(tokens, 0) DESC, idx) AS k FROM tok),
f AS (SELECT l_orderkey, 0::BIGINT AS k, NULL::BIGINT AS idx, NULL::INT AS rank, [0, 0, 0, 0]::BIGINT[] AS loads FROM (SELECT DISTINCT l_orderkey FROM s)
  UNION ALL SELECT f.l_orderkey, s.k, s.idx, (list_position(loads, list_min(loads)) - 1)::INT, list_transform(range(1, 5), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN s.size ELSE 0 END)
  FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.k = f.k + 1)
SELECT l_orderkey, idx::INT AS idx, rank FROM f WHERE k > 0""")
def lpt_assignment(spark, sf):
    rows = items(spark, sf).groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.coalesce("tokens", F.lit(0)).cast("long").alias("size")))), lambda x: x["size"]).alias("sizes"))
    placed = rows.select("l_orderkey", F.explode(R.load_balance(F.col("sizes"), 4)["placed"]).alias("p"))
    return placed.select("l_orderkey", F.col("p.i").alias("idx"), F.col("p.r").alias("rank"))


@query("SELECT c_custkey, ((c_custkey + 6) % 7)::INT AS chunk, (CASE (c_custkey + 2) % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 5 END)::INT AS cpu FROM customer")
def round_robin(spark, sf):
    k = F.col("c_custkey") - 1
    return table(spark, sf, "customer").select("c_custkey", F.pmod(k, F.lit(7)).cast("int").alias("chunk"), F.get(F.array(F.lit(0), F.lit(2), F.lit(5)), F.pmod(k, F.lit(3)).cast("int")).alias("cpu"))


@query("SELECT p_partkey, p_brand, (sum(p_size) OVER w - p_size)::BIGINT AS start, (sum(p_size) OVER w)::BIGINT AS stop FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def range_allocation(spark, sf):
    return R.allocate(table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("long")), ["p_partkey"], "p_size", "p_brand").select("p_partkey", "p_brand", "start", "stop")


@query(f"""WITH {ITEMS_SQL}, m AS (SELECT l_orderkey, idx, h % 2 = 0 AS mask, count(*) FILTER (h % 2 = 0) OVER (PARTITION BY l_orderkey ORDER BY idx) AS k FROM tok),
e AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, idx) AS k, w FROM tok WHERE h % 2 = 0)
SELECT m.l_orderkey, m.idx, CASE WHEN mask THEN e.w ELSE -1 END AS value FROM m LEFT JOIN e ON m.l_orderkey = e.l_orderkey AND m.k = e.k AND mask""")
def scatter_merge(spark, sf):
    rows = items(spark, sf).select("l_orderkey", "idx", "w", (F.col("h") % 2 == 0).alias("mask"))
    order = Window.partitionBy("l_orderkey").orderBy(F.desc(F.when(F.col("mask"), F.col("w"))), "idx")
    made = rows.withColumn("k", F.row_number().over(order).cast("long")).where("mask").select("l_orderkey", "w", "k")
    out = features.scatter(rows.drop("w"), made, "l_orderkey", "idx", "mask", "w", F.lit(-1))
    return out.select("l_orderkey", "idx", F.col("merged").alias("value"))


@query("SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS claimer FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def first_claim_wins(spark, sf):
    rows = table(spark, sf, "events").where("event_type in ('click', 'error')")
    return rows.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("claimer"))


PLAN_SQL = f"""s AS (SELECT event_id, {STATE_SQL} AS state, event_id % 3 = 0 AS granted, CASE event_id % 5 WHEN 1 THEN 'READY' WHEN 2 THEN 'FALLBACK_CLAIMED' END AS claim_state, CASE WHEN event_id % 2 = 0 THEN (user_id % 4)::INT END AS owner FROM events),
p AS (SELECT event_id, state, CASE WHEN state = 'READY' THEN 'ready_before_fallback' WHEN granted THEN 'fallback_claim_granted' WHEN claim_state = 'READY' THEN 'ready_after_claim_race' WHEN claim_state = 'FALLBACK_CLAIMED' AND owner IS NOT NULL THEN 'fallback_claim_already_owned' END AS reason, owner FROM s),
d AS (SELECT event_id, state, reason, CASE WHEN reason LIKE 'ready%' THEN 'USE_SIDECAR' WHEN reason IS NOT NULL THEN 'FALLBACK' END AS decision, CASE WHEN reason = 'fallback_claim_already_owned' THEN owner WHEN reason = 'fallback_claim_granted' THEN 1 END AS producer_rank, CASE WHEN reason IS NULL THEN 'fallback claim denied' END AS error FROM p)"""


def _plan(spark, sf):
    e = F.col("event_id")
    rows = _states(spark, sf).select("event_id", "state", (e % 3 == 0).alias("claim_granted"), F.when(e % 5 == 1, "READY").when(e % 5 == 2, "FALLBACK_CLAIMED").alias("claim_state"), F.when(e % 2 == 0, (F.col("user_id") % 4).cast("int")).alias("owner_rank"))
    return R.source_plan(rows, 1)


@query(f"WITH {PLAN_SQL} SELECT event_id, decision, producer_rank, reason, error FROM d")
def source_plan(spark, sf):
    return _plan(spark, sf).select("event_id", "decision", "producer_rank", "reason", "error")


@query(f"""WITH {PLAN_SQL} SELECT kind, name, n FROM (SELECT 'state' AS kind, lower(state) AS name, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT 'reason', coalesce(reason, 'none'), count(*) FROM d GROUP BY ALL
UNION ALL SELECT 'rank', CASE WHEN error IS NOT NULL THEN 'none' WHEN producer_rank IS NULL THEN 'sidecar' WHEN producer_rank = 1 THEN 'local' ELSE 'remote' END, count(*) FROM d GROUP BY ALL)""")
def plan_diagnostics(spark, sf):
    p = _plan(spark, sf)
    side = F.when(F.col("error").isNotNull(), "none").when(F.col("producer_rank").isNull(), "sidecar").when(F.col("producer_rank") == 1, "local").otherwise("remote")
    named = p.select(F.explode(F.create_map(F.lit("state"), F.lower("state"), F.lit("reason"), F.coalesce("reason", F.lit("none")), F.lit("rank"), side)).alias("kind", "name"))
    return named.groupBy("kind", "name").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT user_id, event_type, max({MS_SQL}) AS put FROM events GROUP BY ALL) SELECT user_id, event_type, put FROM c WHERE put + 86400000 > (SELECT max({MS_SQL}) FROM events)""")
def cache_ttl(spark, sf):
    e = table(spark, sf, "events")
    cache = e.groupBy("user_id", "event_type").agg(F.max(_ms()).alias("put"))
    now = F.broadcast(e.agg(F.max(_ms()).alias("now")))  # one row
    return R.alive(cache.join(now), "put", 86_400_000, F.col("now")).select("user_id", "event_type", "put")


@query("""WITH c AS (SELECT user_id, event_id, (event_id * 7919 % 1000 + 1)::BIGINT AS bytes FROM events), r AS (SELECT *, sum(bytes) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS total FROM c) SELECT user_id, event_id, bytes FROM r WHERE total <= 3000""")
def cache_lru_bytes(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 1000 + 1).alias("bytes"))
    return R.within_budget(rows, "user_id", ["event_id"], "bytes", 3000)


@query("""WITH f AS (SELECT user_id FROM events GROUP BY 1 ORDER BY min(event_id) DESC LIMIT 8), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE user_id IN (SELECT user_id FROM f)) SELECT user_id, event_id FROM r WHERE k <= 4""")
def profile_retention(spark, sf):
    return R.newest(table(spark, sf, "events").select("user_id", "event_id"), "user_id", ["event_id"], 4, 8)


@query("SELECT sha256(coalesce(text, '')) AS cache_key, min(doc_id) AS owner, count(*) AS requests FROM documents GROUP BY 1")
def dedup_cache_key(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("cache_key"))
    return rows.groupBy("cache_key").agg(F.min("doc_id").alias("owner"), F.count("*").alias("requests"))


@query("SELECT count(*) AS texts, count(DISTINCT sha256(coalesce(text, ''))) AS different, count(*) = count(DISTINCT sha256(coalesce(text, ''))) AS is_unique FROM documents")
def uniqueness_audit(spark, sf):
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    d = table(spark, sf, "documents").groupBy(digest.alias("h")).agg(F.count("*").alias("n"))
    d = d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"), F.count("*").alias("different"))
    return d.select("texts", "different", (F.col("texts") == F.col("different")).alias("is_unique"))


@query("""SELECT vec_id, i::INT AS i, (((embedding[i + 1] * (1.0::DOUBLE / 255)::FLOAT)::FLOAT - ([0.5, 0.25, 0.125][i % 3 + 1])::FLOAT)::FLOAT / ([0.5, 0.25, 2.0][i % 3 + 1])::FLOAT)::FLOAT AS v FROM embeddings, range(64) t(i)""")
def tensor_rescale_normalize(spark, sf):
    values = tensor.normalise(tensor.rescale(F.col("embedding"), 1 / 255), (0.5, 0.25, 0.125), (0.5, 0.25, 2.0))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(values).alias("i", "v"))


@query("SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 5) AS mean, round(list_stddev_pop(embedding::DOUBLE[]), 5) AS std, 256::BIGINT AS nbytes FROM embeddings")
def tensor_stats(spark, sf):
    mean, std = tensor.stats(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(mean, 5).alias("mean"), F.round(std, 5).alias("std"), (tensor.element_count(F.array(F.lit(8), F.lit(8), F.lit(1))) * 4).alias("nbytes"))


@query("""SELECT vec_id, ((((i // 8) // 4 * 2 + (i % 8) // 4) * 2 + ((i // 8) % 4) // 2) * 2 + ((i % 8) % 4) // 2)::INT AS row, (((i // 8) % 2) * 2 + i % 2)::INT AS col, embedding[i + 1] AS v FROM embeddings, range(64) t(i)""")
def patchify(spark, sf):
    row, col = tensor.patch_position(F.col("i"), 1, 1, 8, 8, 2, 2)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", row.alias("row"), col.alias("col"), "v")


@query(SQL["patchify"])
def patchify_numpy(spark, sf):
    def run(batches):
        for batch in batches:
            flat = batch.column(1).to_pylist()
            made = [tensor.patches(np.asarray(e, dtype=np.float32).reshape(1, 1, 8, 8), 2, 2) for e in flat]
            rows, cols = np.divmod(np.tile(np.arange(64, dtype=np.int32), len(made)), 4)
            values = np.concatenate([m.ravel() for m in made]) if made else np.empty(0, dtype=np.float32)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(made)), 64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(values, pa.float32())], ["vec_id", "row", "col", "v"])

    return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, row int, col int, v float")


@query("""SELECT conv_id, count(*) AS parts, string_agg(coalesce(role, '') || ':' || length(coalesce(text, '')), ',' ORDER BY turn NULLS FIRST, coalesce(role, '') || ':' || length(coalesce(text, ''))) AS shape FROM conversations GROUP BY 1""")
def chat_payload_shape(spark, sf):
    rows = table(spark, sf, "conversations")
    part = F.struct("turn", F.concat(F.coalesce("role", F.lit("")), F.lit(":"), F.length(F.coalesce("text", F.lit(""))).cast("string")).alias("s"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("parts"), F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["s"]), ",").alias("shape"))


@query("SELECT event_id, greatest(event_id % 7, 0)::INT AS tokens, round(greatest(value, 0) / greatest(event_id % 7 - 1, 1), 6) AS tpot, sha256(event_type) AS completion, trim(lower(event_type)) = 'click' AS semantic FROM events")
def latency_metrics(spark, sf):
    n = F.col("event_id") % 7
    return table(spark, sf, "events").select("event_id", n.cast("int").alias("tokens"), F.round(F.greatest("value", F.lit(0.0)) / F.greatest(n - 1, F.lit(1)), 6).alias("tpot"), F.sha2("event_type", 256).alias("completion"), (F.trim(F.lower("event_type")) == "click").alias("semantic"))
