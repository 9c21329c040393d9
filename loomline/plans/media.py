"""Queries of images, sources, payloads and contracts. Pixels and payloads are made of the tables' numbers and texts."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomline.functions import geometry, identity, payloads, signature
from loomline.functions.images import Processor, encode_png
from loomline.operators import contracts, images
from loomline.plans.catalog import SIDES_SQL, resize_sql
from loomline.plans.registry import Fixture, query
from loomline.sources import media

VECTORS = Fixture("e", "embeddings", {"vec_id": "vec_id"})


def _data_urls(spark, sf):
    """A PNG of 8 x 8 pixels in a data URL for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x, c = np.meshgrid(np.arange(8), np.arange(8), np.arange(3), indexing="ij")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = ["data:image/png;base64," + base64.b64encode(encode_png(((i * 7 + (y * 8 + x) * 13 + c * 50) % 256).astype(np.uint8))).decode() for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["vec_id", "url"])

    return VECTORS(spark, sf).mapInArrow(run, "vec_id long, url string")


@query("""WITH p AS (SELECT vec_id, y, x, c, t, ((((((vec_id * 7 + (y * 8 + x) * 13 + c * 50) % 256)::FLOAT * (1.0::DOUBLE / 255)::FLOAT)::FLOAT - ([0.5, 0.25, 0.125][c + 1])::FLOAT)::FLOAT / ([0.5, 0.25, 2.0][c + 1])::FLOAT)::FLOAT)::DOUBLE AS v
  FROM embeddings, range(8) a(y), range(8) b(x), range(3) d(c), range(2) f(t)),
q AS (SELECT vec_id, ((y // 4 * 2 + x // 4) * 2 + y % 4 // 2) * 2 + x % 4 // 2 AS row, ((c * 2 + t) * 2 + y % 2) * 2 + x % 2 AS col, v FROM p)
SELECT vec_id, row::INT AS row, count(*) AS n, round(sum(v * (col + 1)), 2) AS total FROM q GROUP BY ALL""")
def image_pipeline(spark, sf):
    rows = media.data_url_bytes(_data_urls(spark, sf), "url").select("vec_id", "content")
    made = images.run_locally(rows, "vec_id", processor=Processor(patch=2, merge=2, temporal=2, min_pixels=16, max_pixels=64, mean=(0.5, 0.25, 0.125), std=(0.5, 0.25, 2.0)))
    cells = images.patch_rows(made).select(F.col("key").cast("long").alias("vec_id"), "row", "col", F.col("value").cast("double").alias("v"))
    return cells.groupBy("vec_id", "row").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v") * (F.col("col") + 1)), 2).alias("total"))


@query("SELECT vec_id, 8::INT AS width, 8::INT AS height FROM embeddings")
def probe_inline_images(spark, sf):
    rows = _data_urls(spark, sf).select("vec_id", F.lit("base64").alias("transport"), F.col("url").alias("image_url"), F.lit(None).cast("binary").alias("content"))
    remote = rows.withColumn("transport", F.lit("http"))
    return media.probe_captures(rows.unionByName(remote), "vec_id").select(F.col("key").cast("long").alias("vec_id"), "width", "height")


PLANNED_SIG = "CASE WHEN doc_id % 3 = 0 THEN 'patch=16|do_resize=0' WHEN doc_id % 3 = 1 THEN 'patch=14|merge=2|min_pixels=3136|max_pixels=1003520' ELSE 'junk|merge=2|max_pixels=1003520|min_pixels=3136' END"


@query(f"""WITH {SIDES_SQL}, r AS (SELECT doc_id, h, w, {resize_sql("h", "w")[0]} AS a, {resize_sql("h", "w")[1]} AS b FROM d), s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 16 ELSE 14 END AS p, CASE WHEN doc_id % 3 = 0 THEN greatest(32, h) ELSE a END AS rh, CASE WHEN doc_id % 3 = 0 THEN greatest(32, w) ELSE b END AS rw FROM r)
SELECT doc_id, rh::INT AS rh, rw::INT AS rw, 1::INT AS grid_t, CASE WHEN rh > 0 THEN greatest(1, rh // p) END::INT AS grid_h, CASE WHEN rh > 0 THEN greatest(1, rw // p) END::INT AS grid_w, CASE WHEN rh > 0 THEN greatest(1, greatest(1, rh // p) * greatest(1, rw // p) // 4) END::INT AS tokens FROM s""")
def planner_schedule(spark, sf):
    d = Fixture("d", "documents", {"doc_id": "doc_id", "h": "CAST(doc_id * 37 % 3000 + 1 AS INT)", "w": "CAST(n_chars * 13 % 2800 + 1 AS INT)", "sig": PLANNED_SIG})(spark, sf)
    item = geometry.planned(F.col("h"), F.col("w"), signature.parse(F.col("sig")))
    return d.select("doc_id", item.alias("i")).select("doc_id", "i.*")


@query("""SELECT p_partkey, 'model=' || p_name || '|rev=main|processor=fast|patch=' || (10 + p_size % 5) || '|merge=2|temporal=2|min_pixels=3136|max_pixels=1003520|do_resize=' || (p_partkey % 2) || '|resize_strategy=smart|crop_strategy=none|pad_strategy=none|resample=bicubic|do_rescale=1|rescale_factor=0.00392156862745098|do_normalize=1|image_mean=0.5,0.5,0.5|image_std=0.5,0.25,1.0|do_convert_rgb=1|data_format=channels_first|output_dtype=float32' AS sig FROM part""")
def processor_signature(spark, sf):
    p = Fixture("p", "part", {"p_partkey": "p_partkey", "p_name": "p_name", "p_size": "p_size"})(spark, sf)
    sig = signature.processor(model=F.col("p_name"), rev="main", processor="fast", patch=10 + F.col("p_size") % 5, min_pixels=3136, max_pixels=1_003_520, do_resize=F.col("p_partkey") % 2 == 1, image_std=(0.5, 0.25, 1.0))
    return p.select("p_partkey", sig.alias("sig"))


@query(f"WITH {SIDES_SQL}, r AS (SELECT doc_id, {resize_sql('h', 'w', 'C')[0]} AS rh, {resize_sql('h', 'w', 'C')[1]} AS rw FROM d) SELECT doc_id, (rh // 14)::INT AS grid_h, (rw // 14)::INT AS grid_w, ((rh // 14) * (rw // 14) // 4)::INT AS tokens, '(' || ((rh // 14) * (rw // 14)) || ', 1176)' AS payload_shape, 'float32' AS dtype FROM r WHERE rh IS NOT NULL")
def bench_metadata(spark, sf):
    d = Fixture("d", "documents", {"doc_id": "doc_id", "h": "CAST(doc_id * 37 % 3000 + 1 AS INT)", "w": "CAST(n_chars * 13 % 2800 + 1 AS INT)"})(spark, sf)
    rows = d.select("doc_id", geometry.bench_metadata(F.col("h"), F.col("w"), 14, 2, 2, 3, 3136, 1_003_520).alias("m"))
    return rows.select("doc_id", "m.*").where("grid_h is not null")


ORDERS = Fixture("o", "orders", {"k": "o_orderkey", "c": "o_custkey", "idx": "CAST(o_orderkey % 4 AS INT)"})


@query("SELECT o_orderkey AS k, 'r' || o_custkey AS request_id, (o_orderkey % 4)::INT AS request_media_index, 'base64' AS transport, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 2 END AS byte_size, 30000::INT AS http_timeout_ms, CASE WHEN o_orderkey % 2 = 0 THEN 'accept=*/*' END AS header, CASE WHEN o_orderkey % 5 = 0 THEN 512::INT END AS orig_h, 'i' || o_orderkey AS item_identity FROM orders")
def descriptor_roundtrip(spark, sf):
    k = F.col("k")
    source = F.struct(F.lit("base64").alias("transport"), F.concat(F.lit("i"), k.cast("string")).alias("source_key"), F.lit("u").alias("media_uuid"), F.lit(None).cast("string").alias("request_scope_key"), F.lit("data:image/png;base64,AA==").alias("image_url"), F.lit(None).cast("string").alias("local_path"), F.lit("image/png").alias("mime_type"))
    captured = F.struct(source.alias("source_ref"), F.lit("image/png").alias("mime_type"), F.when(k % 3 > 0, k * 2).alias("byte_size"), F.lit(None).cast("string").alias("local_materialized_path"))
    limits = F.struct(F.lit(20).alias("max_image_count"), F.lit(1 << 24).alias("max_encoded_bytes"), F.lit(1 << 28).alias("max_decoded_bytes"), F.lit(1 << 24).alias("max_pixels_per_image"))
    headers = F.when(k % 2 == 0, F.expr("array(array('accept', '*/*'))")).otherwise(F.expr("CAST(array() AS array<array<string>>)"))
    text = payloads.descriptor(F.concat(F.lit("r"), F.col("c").cast("string")), F.col("idx"), captured, limits, F.lit("s"), F.concat(F.lit("i"), k.cast("string")), F.when(k % 5 == 0, F.array(F.lit(512), F.lit(288))), headers, F.lit(30_000), F.lit(True))
    d = ORDERS(spark, sf).select("k", payloads.decode(text, payloads.DESCRIPTOR).alias("d"))
    return d.select("k", "d.request_id", "d.request_media_index", "d.captured_image.source_ref.transport", "d.captured_image.byte_size", "d.http_timeout_ms", F.array_join(F.get("d.http_headers", F.lit(0)), "=").alias("header"), F.get("d.orig_size_hw", F.lit(0)).alias("orig_h"), "d.item_identity")


@query("""WITH i AS (SELECT o_custkey % 300 AS req, count(*) AS n, sum(o_orderkey % 7) AS tokens, count(*) FILTER (o_orderkey % 3 = 0) AS planned, max(o_orderkey) AS top FROM orders GROUP BY 1)
SELECT req, CASE WHEN req % 3 = 0 THEN 1 ELSE 1 END::INT AS version, req % 2 = 0 AS enabled, CASE WHEN req % 5 = 0 THEN 'why' END AS reason, n::INT AS prepared_image_count, tokens::INT AS total_placeholder_token_count, planned::INT AS n_planned, n::INT AS n_handles, 'k' || top AS last_key FROM i""")
def plan_payload_roundtrip(spark, sf):
    rows = ORDERS(spark, sf).withColumn("req", F.col("c") % 300)
    handle = payloads.handle(F.lit("r"), F.col("idx"), F.concat(F.lit("k"), F.col("k").cast("string")), F.lit(1))
    item = F.when(F.col("k") % 3 == 0, payloads.encode(request_media_index=F.col("idx"), placeholder_token_count=F.lit(1)))
    made = rows.groupBy("req").agg(F.count("*").cast("int").alias("n"), F.sum(F.col("k") % 7).cast("int").alias("tokens"), F.collect_list(item).alias("items"), F.transform(F.sort_array(F.collect_list(F.struct("k", handle.alias("h")))), lambda x: x["h"]).alias("handles"))
    text = payloads.plan(F.concat(F.lit("r"), F.col("req").cast("string")), F.col("req") % 2 == 0, F.when(F.col("req") % 5 == 0, "why"), F.lit("s"), F.col("n"), F.col("tokens"), F.concat(F.col("items"), F.array(F.lit("3"), F.lit("null"))), F.array().cast("array<string>"), F.col("handles"))
    got = made.select("req", payloads.decode_plan(text).alias("p"))
    last = payloads.decode(F.element_at("p.handles", -1), payloads.HANDLE)["cache_key"]
    return got.select("req", "p.version", "p.enabled", "p.reason", "p.prepared_image_count", "p.total_placeholder_token_count", F.size("p.planned_items").alias("n_planned"), F.size("p.handles").alias("n_handles"), last.alias("last_key"))


@query("""WITH d AS (SELECT doc_id, text, n_chars, doc_id % 4 AS k, starts_with(ltrim(text, ' '), '{') AS braced FROM documents)
SELECT doc_id, CASE WHEN k < 3 OR braced THEN 1 END::INT AS version, CASE WHEN k < 3 OR braced THEN k = 1 END AS enabled, CASE WHEN k = 1 THEN n_chars WHEN k < 3 OR braced THEN 0 END::INT AS images,
  CASE WHEN k < 3 THEN sha256(text) END AS request, CASE WHEN k = 1 THEN 1 WHEN k < 3 OR braced THEN 0 END::INT AS n_handles FROM d""")
def tolerant_plan(spark, sf):
    """Plans whose request is named by a whole text: with most keys, with none but it, and texts that are no plan."""
    docs = Fixture("d", "documents", {"doc_id": "doc_id", "text": "text", "n_chars": "n_chars"})(spark, sf)
    full = "to_json(struct(text AS request_id, true AS enabled, n_chars AS prepared_image_count, array(struct(text AS cache_key)) AS handles))"
    payload = F.expr(f"CASE WHEN doc_id % 4 = 1 THEN {full} WHEN doc_id % 4 < 3 THEN to_json(struct(text AS request_id)) ELSE text END")
    got = docs.select("doc_id", payloads.decode_plan(payload).alias("p"))
    handles = F.when(F.col("p").isNotNull(), F.size("p.handles"))
    return got.select("doc_id", "p.version", "p.enabled", F.col("p.prepared_image_count").alias("images"), F.sha2("p.request_id", 256).alias("request"), handles.alias("n_handles"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 3 = 1 AND starts_with(text, '{') THEN sha256(text) WHEN doc_id % 3 = 1 THEN sha256(source) END AS found, CASE WHEN lang = 'en' OR lang IS NULL THEN source || '|' || doc_id ELSE lang || doc_id END AS mm_hash FROM documents""")
def payload_lookup(spark, sf):
    """Payloads around whole texts: in a request's own arguments, in its features' where those are no object, or nowhere."""
    docs = Fixture("d", "documents", {"doc_id": "doc_id", "text": "text", "source": "source", "lang": "lang"})(spark, sf)
    k = F.col("doc_id") % 3
    around = lambda c: F.to_json(F.struct(F.col(c).alias("inner")))
    params = F.when(k == 0, F.create_map(F.lit("request_plan"), around("text"))).when(k == 1, F.create_map(F.lit("request_plan"), F.when(F.col("text").startswith("{"), around("text")).otherwise(F.col("text"))))
    nested = F.when(k != 2, F.array(F.create_map(F.lit("other"), around("text")), F.create_map(F.lit("request_plan"), around("source"))))
    key = F.when(F.col("lang") == "en", "").otherwise(F.concat("lang", F.col("doc_id").cast("string")))
    found = F.get_json_object(payloads.found_payload(params, nested), "$.inner")
    return docs.select("doc_id", F.sha2(found, 256).alias("found"), payloads.mm_hash(key, F.col("source"), F.col("doc_id").cast("string")).alias("mm_hash"))


@query("SELECT conv_id, count(*) AS prompt_parts, sum(len(text))::BIGINT AS prompt_chars, count(*) FILTER (turn % 2 = 0) AS image_uuids, count(*) FILTER (turn % 2 = 1) AS audio_uuids FROM conversations GROUP BY 1")
def prompt_metadata(spark, sf):
    rows = Fixture("c", "conversations", {"conv_id": "conv_id", "text": "text", "modality": "CASE WHEN turn % 2 = 0 THEN 'image' WHEN turn % 2 = 1 THEN 'audio' END"})(spark, sf)
    of = lambda m: F.count_if(F.col("modality") == m).alias(f"{m}_uuids")
    return rows.groupBy("conv_id").agg(F.count("*").alias("prompt_parts"), F.sum(F.length("text")).alias("prompt_chars"), of("image"), of("audio"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 AND html IS NOT NULL THEN html ELSE url END AS model, CASE WHEN page_id % 3 = 0 THEN page_id::VARCHAR END AS seed, length(html)::VARCHAR AS n FROM pages")
def payload_overrides(spark, sf):
    """Payloads that carry a page's URL, some of which get its whole HTML in the URL's place."""
    pages = Fixture("p", "pages", {"page_id": "page_id", "url": "url", "html": "html"})(spark, sf)
    k = F.col("page_id")
    m = payloads.overridden(F.expr("to_json(struct(url AS model, length(html) AS n))"), model=F.when(k % 2 == 0, F.col("html")), seed=F.when(k % 3 == 0, k))
    return pages.select("page_id", m.alias("m")).select("page_id", *(F.try_element_at("m", F.lit(c)).alias(c) for c in ("model", "seed", "n")))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 14 END::INT AS patch, CASE WHEN p_size % 3 = 0 THEN 4 ELSE 2 END::INT AS merge, 2::INT AS temporal, 3::INT AS channels, CASE WHEN p_size % 5 = 0 THEN 100 WHEN p_size % 3 = 0 THEN 56 ELSE 3136 END::INT AS min_pixels, CASE WHEN p_size % 3 = 0 THEN 900 ELSE 12845056 END::INT AS max_pixels FROM part")
def model_config(spark, sf):
    p = Fixture("p", "part", {"p_partkey": "p_partkey", "p_size": "p_size"})(spark, sf)
    s = F.col("p_size")
    config = F.concat(F.lit('{"vision_config": {"patch_size": '), F.when(s % 2 == 0, s.cast("string")).otherwise('"x"'), F.lit(', "spatial_merge_size": 2}}'))
    pre = F.concat(F.lit("{"), F.when(s % 3 == 0, '"merge_size": 4, "size": {"shortest_edge": 56, "longest_edge": 900}').otherwise('"other": 1'), F.when(s % 5 == 0, ', "min_pixels": 100').otherwise(""), F.lit("}"))
    return p.select("p_partkey", payloads.probe_config(config, pre).alias("c")).select("p_partkey", "c.*")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'file:///data/a/' || page_id || '.jpg' WHEN 1 THEN 'http://h/b/' || CASE WHEN page_id % 2 = 0 THEN 'a/' ELSE '' END || page_id || '.jpg' ELSE 'data:image/jpeg;base64,' || to_base64(encode(url)) END AS shown,
  CASE WHEN page_id % 3 = 2 THEN to_base64(encode(url)) ELSE url END AS coded FROM pages WHERE url IS NOT NULL""")
def transport_urls(spark, sf):
    p = Fixture("p", "pages", {"page_id": "page_id", "url": "url"}, "url IS NOT NULL")(spark, sf)
    n = F.col("page_id").cast("string")
    path = F.concat(F.when((F.col("page_id") % 3 != 1) | (F.col("page_id") % 2 == 0), "/data/a/").otherwise("/elsewhere/"), n, F.lit(".jpg"))
    kind = F.get(F.array(*map(F.lit, ("local_path", "http", "base64"))), (F.col("page_id") % 3).cast("int"))
    shown = payloads.rendered_url(kind, path, F.lit("http://h/b/"), F.lit("/data"), F.col("url").cast("binary"))
    return p.select("page_id", shown.alias("shown"), payloads.base64_part(F.when(F.col("page_id") % 3 == 2, shown).otherwise(F.col("url"))).alias("coded"))


@query("""WITH t AS (SELECT conv_id, count(*) AS n, min(turn) AS a FROM conversations GROUP BY 1) SELECT conv_id, (1 + n)::INT AS parts, 'conv ' || conv_id AS text, 'http://h/' || a || '.jpg' AS first_url, n::INT AS images FROM t""")
def chat_payload(spark, sf):
    c = Fixture("c", "conversations", {"conv_id": "conv_id", "turn": "turn"})(spark, sf)
    urls = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.concat(F.lit("file:///m/"), t.cast("string"), F.lit(".jpg")))
    rows = c.groupBy("conv_id").agg(urls.alias("urls"))
    parts = payloads.chat_parts(F.concat(F.lit("conv "), F.col("conv_id").cast("string")), F.col("urls"))
    over_http = payloads.rewritten_parts(parts, lambda u: F.concat(F.lit("http://h/"), payloads.relative_path(F.replace(u, F.lit("file://"), F.lit("")), F.lit("/m"))))
    rows = rows.select("conv_id", F.from_json(F.to_json(over_http), f"array<{payloads.PART}>").alias("p"))
    shown = F.filter("p", lambda x: x["type"] == "image_url")
    return rows.select("conv_id", F.size("p").alias("parts"), F.col("p")[0]["text"].alias("text"), F.get(shown, F.lit(0))["image_url"]["url"].alias("first_url"), F.size(shown).alias("images"))


_ADJ = "[" + ", ".join(f"'{w}'" for w in payloads.ADJECTIVES) + "]"
_NOUN = "[" + ", ".join(f"'{w}'" for w in payloads.NOUNS) + "]"


@query(f"""WITH s AS (SELECT event_id, event_id % 120 AS r, event_id AS n, 'r' || CASE WHEN event_id % 120 < 10 THEN '0' ELSE '' END || (event_id % 120) || '_s' || CASE WHEN event_id < 100000 THEN lpad(event_id::VARCHAR, 5, '0') ELSE event_id::VARCHAR END AS code FROM events)
SELECT event_id, 'Segment ' || code || ' records a ' || ({_ADJ})[(n % 8) + 1] || ' ' || ({_NOUN})[(n * 3 % 8) + 1] || ' for service tracing. It includes identifiers ' || r || '/' || n || '/' || (r * 1000 + n) || ' and unique markers ' || upper(code) || '::' || (n * 17 + r) || '. This line is intentionally unique within and across rounds.' || chr(10) AS sentence FROM s""")
def sentences(spark, sf):
    return Fixture("v", "events", {"event_id": "event_id"})(spark, sf).select("event_id", payloads.sentence(F.col("event_id") % 120, F.col("event_id")).alias("sentence"))


@query("SELECT p_partkey, 'worker:patch=' || p_size || ':merge=2:temporal=2:channels=3:min_pixels=3136:max_pixels=1003520:resize_backend=C:do_resize=' || (p_partkey % 2) AS sig, CASE WHEN p_partkey % 3 = 0 THEN 'http:u' || p_partkey WHEN p_partkey % 3 = 1 THEN 'local:n' || p_partkey || ':' || p_size || ':5' ELSE 'base64:4:QUJD:QUJD' END AS identity FROM part")
def bench_names(spark, sf):
    p = Fixture("p", "part", {"p_partkey": "p_partkey", "p_size": "p_size"})(spark, sf)
    k = F.col("p_partkey")
    sig = payloads.bench_signature(F.lit("worker"), F.col("p_size"), F.lit(2), F.lit(2), F.lit(3), F.lit(3136), F.lit(1_003_520), F.lit("C"), k % 2)
    kind = F.get(F.array(*map(F.lit, ("http", "local_path", "base64"))), (k % 3).cast("int"))
    url = F.when(k % 3 == 2, "data:image/png;base64,QUJD").otherwise(F.concat(F.lit("u"), k.cast("string")))
    return p.select("p_partkey", sig.alias("sig"), identity.bench_identity(kind, url, F.concat(F.lit("n"), k.cast("string")), F.col("p_size"), F.lit(5)).alias("identity"))


@query("SELECT page_id, t.transport, 'image:' || page_id || ':' || t.transport AS source FROM pages, (VALUES ('local_path'), ('http'), ('base64')) t(transport)")
def transport_scenarios(spark, sf):
    p = Fixture("p", "pages", {"page_id": "page_id"})(spark, sf)
    rows = p.withColumn("transport", F.explode(F.array(*map(F.lit, ("local_path", "http", "base64")))))
    return rows.withColumn("source", F.concat_ws(":", F.lit("image"), F.col("page_id").cast("string"), "transport"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 50 + 1)::INT END AS h, CASE WHEN doc_id % 2 = 0 THEN 'image/png' WHEN doc_id % 3 = 0 THEN 'image/jpeg' ELSE 'image/unknown' END AS mime FROM documents")
def normalized_images(spark, sf):
    d = Fixture("d", "documents", {"doc_id": "doc_id"})(spark, sf)
    i = F.col("doc_id")
    captured = F.when(i % 2 == 0, "image/png").otherwise("")
    path = F.when(i % 3 == 0, "/x/y.JPG").otherwise("/x/none")
    mime = F.coalesce(F.nullif(captured, F.lit("")), identity.mime(F.lit("nourl"), F.lit(""), path))
    return d.select("doc_id", F.when(i % 4 != 0, (i % 50 + 1).cast("int")).alias("h"), mime.alias("mime"))


_SIDE = "length(regexp_replace(html, '[^a-z]', '', 'g'))"


@query(f"""WITH c AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, ({_SIDE})::INT AS w, length(url) * 40 AS h FROM pages)
SELECT page_id AS pos, url AS id, coalesce(title, 'unknown') AS author, w AS width, h::INT AS height, url AS download_url, count(*) OVER () >= 10 AS enough FROM c WHERE w >= 900 AND h >= 900 AND page_id % 13 <> 1 AND url IS NOT NULL ORDER BY page_id LIMIT 10""")
def photo_catalog(spark, sf):
    """Pages as photos: the title's author, sides counted from the HTML's letters and the URL's."""
    fields = f"url AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS author, CASE WHEN page_id % 13 = 1 THEN 'x' ELSE CAST({_SIDE.replace(", 'g'", '')} AS string) END AS width, length(url) * 40 AS height, url AS download_url"
    pages = Fixture("p", "pages", {"pos": "page_id", "page_id": "page_id", "url": "url", "html": "html"})(spark, sf)
    return media.catalog(pages.select("pos", F.expr(f"to_json(struct({fields}))").alias("item")), 10)


@query("WITH l AS (SELECT url, row_number() OVER (ORDER BY page_id) - 1 AS k FROM pages WHERE page_id % 4 > 1 AND trim(url, ' ') <> '' ORDER BY page_id LIMIT 12) SELECT 'explicit-' || lpad(k::VARCHAR, 2, '0') AS id, trim(url, ' ') AS url FROM l")
def explicit_urls(spark, sf):
    line = F.expr("CASE page_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN concat('# ', url) ELSE concat(' ', url, ' ') END")
    return media.explicit_urls(Fixture("p", "pages", {"page_id": "page_id", "url": "url"})(spark, sf).select(F.col("page_id").alias("pos"), line.alias("line")), 12)


@query("""WITH l AS (SELECT conv_id, turn, text, coalesce(length(text) % 7 = 0, FALSE) AS done, role = 'assistant' AND text <> '' AS said FROM conversations), d AS (SELECT conv_id, min(turn) AS z FROM l WHERE done GROUP BY 1),
c AS (SELECT l.conv_id, turn, text, coalesce(said AND NOT done AND (z IS NULL OR turn < z), FALSE) AS ok FROM l LEFT JOIN d ON l.conv_id IS NOT DISTINCT FROM d.conv_id)
SELECT conv_id, (min(turn * 2) FILTER (ok))::BIGINT AS first_token_at, (max(turn * 2) FILTER (ok))::BIGINT AS last_token_at, count(*) FILTER (ok) AS tokens, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (ok), '')) AS text_sha256 FROM c GROUP BY 1""")
def token_stream(spark, sf):
    """Conversations as responses: what the assistant says are event lines, the rest are comments; some texts end the response."""
    line = F.expr("""CASE WHEN length(text) % 7 = 0 THEN 'data: [DONE]' WHEN role = 'assistant' THEN concat('data: ', to_json(struct(array(struct(struct(text AS content) AS delta)) AS choices))) ELSE ': ping' END""")
    rows = Fixture("c", "conversations", {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"})(spark, sf)
    lines = rows.select("conv_id", F.col("turn").alias("seq"), (F.col("turn").cast("long") * 2).alias("at"), line.alias("line"))
    return media.streamed(lines, "conv_id").withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'request_id' WHEN o_orderkey % 5 = 0 THEN 'http_timeout_ms' WHEN o_orderkey % 3 = 0 THEN 'orig_size_hw' END AS fallback, CASE WHEN o_orderkey % 7 = 0 THEN 'item_identity' WHEN o_orderkey % 3 = 0 THEN 'image_grid_thw' WHEN o_orderkey % 5 = 0 THEN 'placeholder_token_count' END AS schedule_item,
  CASE WHEN o_orderkey % 11 = 0 THEN 'source_key' WHEN o_orderkey % 2 = 0 THEN 'image_url' END AS media_source, CASE WHEN o_orderkey % 4 = 0 THEN 'total' WHEN o_orderkey % 4 = 1 THEN 'items' END AS manifest, CASE WHEN o_orderkey % 3 = 0 THEN 'image_grid_thw' WHEN o_orderkey % 6 = 1 THEN 'payload_nbytes' END AS artifact FROM orders""")
def contract_violations(spark, sf):
    o = Fixture("o", "orders", {
        "k": "o_orderkey", "request_id": "CASE WHEN o_orderkey % 7 <> 0 THEN 'r' ELSE '' END", "request_media_index": "0", "item_identity": "CASE WHEN o_orderkey % 7 <> 0 THEN 'i' END", "processor_signature": "'s'", "http_timeout_ms": "CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END",
        "orig_size_hw": "CASE WHEN o_orderkey % 3 = 0 THEN array(1, 0) WHEN o_orderkey % 3 = 1 THEN array(1, 2) END", "item_index": "0", "image_grid_thw": "CASE WHEN o_orderkey % 3 = 0 THEN array(1, 2) ELSE array(1, 2, 3) END", "placeholder_token_count": "CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END",
        "transport": "CASE WHEN o_orderkey % 2 = 0 THEN 'http' ELSE 'local_path' END", "source_key": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'k' END", "media_uuid": "'u'", "local_path": "'/p'", "image_url": "''",
        "tokens": "array(2L, 3L)", "image_count": "CASE WHEN o_orderkey % 4 = 1 THEN 3 ELSE 2 END", "total_placeholder_token_count": "CASE WHEN o_orderkey % 4 = 0 THEN 6 ELSE 5 END",
        "artifact_id": "'a'", "payload_shape": "array(2, 2)", "dtype": "'float32'", "payload_nbytes": "CASE WHEN o_orderkey % 6 = 1 THEN 0 WHEN o_orderkey % 6 = 2 THEN NULL ELSE 4 END",
    })(spark, sf)
    # A manifest, an artifact and an item of one row share columns; an artifact's identity is always there.
    told = o.select("k", *(contracts.violation(e).alias(e) for e in ("fallback", "schedule_item", "media_source", "manifest")))
    artifact = o.withColumn("item_identity", F.lit("i")).select("k", contracts.violation("artifact").alias("artifact"))
    return told.join(artifact, "k")
