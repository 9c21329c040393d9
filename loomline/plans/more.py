"""Queries of caches, allocations, extractions, profiles of one request, resized pixels and tensor files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomline.functions import geometry, identity, payloads, tensor
from loomline.operators import features as T
from loomline.operators import profiles as P
from loomline.operators import relational as R
from loomline.plans.catalog import SIDES_SQL, resize_sql
from loomline.plans.registry import Fixture, query, table
from loomline.sources import media

CACHE = {"grp": "user_id % 30", "seq": "event_id", "kind": "CASE WHEN event_id % 3 = 0 THEN 'get' ELSE 'put' END", "key": "concat('k', CAST(event_id % 7 AS VARCHAR(20)))", "size": "event_id * 7919 % 60 + 1", "at": "event_id * 10"}


@query(f"""WITH RECURSIVE {Fixture("v", "events", CACHE, "user_id IS NOT NULL").sql}, x AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY seq) AS n FROM v),
f AS (SELECT DISTINCT grp, 0::BIGINT AS n, []::STRUCT(key VARCHAR, size BIGINT, used BIGINT, expires BIGINT)[] AS e, 0 AS hits, 0 AS misses FROM x UNION ALL
  SELECT grp, n, CASE WHEN kind = 'put' THEN list_filter(l, lambda v: list_sum([w.size FOR w IN l IF w.used >= v.used]) <= 120) ELSE l END, hits + (kind = 'get' AND hit)::INT, misses + (kind = 'get' AND NOT hit)::INT FROM (
    SELECT f.grp, x.n, x.kind, hits, misses, len([v FOR v IN e IF v.expires > x.at AND v.key = x.key]) > 0 AS hit,
      CASE WHEN x.kind = 'put' THEN list_append([v FOR v IN e IF v.expires > x.at AND v.key <> x.key], {{'key': x.key, 'size': x.size, 'used': x.seq, 'expires': x.at + 9000}})
        ELSE [{{'key': v.key, 'size': v.size, 'used': CASE WHEN v.key = x.key THEN x.seq ELSE v.used END, 'expires': v.expires}} FOR v IN e IF v.expires > x.at] END AS l
    FROM f JOIN x ON x.grp = f.grp AND x.n = f.n + 1))
SELECT grp, hits, misses, array_to_string(list_sort([v.key FOR v IN e]), ',') AS keys FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC) AS last FROM f) WHERE last = 1""")
def cache_get_put(spark, sf):
    return R.cache_fold(Fixture("v", "events", CACHE, "user_id IS NOT NULL")(spark, sf), "grp", 9000, 120)


@query("SELECT p_partkey, p_brand, (sum(p_size) OVER w - p_size)::BIGINT AS start, (sum(p_size) OVER w)::BIGINT AS stop, CASE WHEN sum(p_size) OVER w > 1500 THEN 'not enough items left' END AS error FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def allocate_case_images(spark, sf):
    rows = table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("long"))
    return R.allocate_within(rows, ["p_partkey"], "p_size", "p_brand", F.lit(1500)).select("p_partkey", "p_brand", "start", "stop", "error")


@query(f"""WITH {SIDES_SQL}, a AS (SELECT doc_id, {resize_sql("h", "w")[0]} AS gh, {resize_sql("h", "w")[1]} AS gw FROM d), b AS (SELECT doc_id, {resize_sql("h", "w", "B")[0]} AS gh, {resize_sql("h", "w", "B")[1]} AS gw FROM d WHERE doc_id % 10 <> 0),
j AS (SELECT a.gh AS ah, a.gw AS aw, b.gh AS bh, b.gw AS bw, b.doc_id IS NULL AS one FROM a LEFT JOIN b USING (doc_id))
SELECT m.mode, count(*) FILTER (CASE m.mode WHEN 'count' THEN one WHEN 'tokens' THEN one OR ah * aw IS DISTINCT FROM bh * bw ELSE one OR ah IS DISTINCT FROM bh OR aw IS DISTINCT FROM bw END) AS mismatches, count(*) AS rows FROM j, (VALUES ('count'), ('tokens'), ('grid')) m(mode) GROUP BY 1""")
def extraction_compare(spark, sf):
    d = Fixture("d", "documents", {"doc_id": "doc_id", "h": "CAST(doc_id * 37 % 3000 + 1 AS INT)", "w": "CAST(n_chars * 13 % 2800 + 1 AS INT)"})(spark, sf)

    def made(variant):
        gh, gw = geometry.resized(F.col("h"), F.col("w"), 28, 3136, 1_003_520, variant)
        return d.select("doc_id", gh.alias("gh"), gw.alias("gw")).withColumn("area", F.col("gh").cast("long") * F.col("gw"))

    return R.compare_modes(made("A"), made("B").where("doc_id % 10 <> 0"), ["doc_id"], {"count": [], "tokens": ["area"], "grid": ["gh", "gw"]})


@query("""WITH r AS (SELECT event_id AS row, event_type AS key, value FROM events WHERE user_id = 7), n AS (SELECT count(*) AS n FROM r), g AS (SELECT key, sum(value) AS s, max(value) AS m, count(*) AS k FROM r GROUP BY 1)
SELECT 7::BIGINT AS user_id, key, round(s / n, 9) AS avg, CASE WHEN k < n THEN greatest(m, 0.0) ELSE m END AS max, n AS profiles FROM g, n""")
def request_profiles(spark, sf):
    rows = Fixture("r", "events", {"user_id": "user_id", "row": "event_id", "key": "event_type", "value": "value"})(spark, sf)
    out = P.refreshed(P.of_request(rows, "user_id", 7), "user_id", "row", "key", "value")
    return out.select("user_id", "key", F.round("avg", 9).alias("avg"), "max", "profiles")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/a b/' || page_id || '+x.png' WHEN 1 THEN 'plain/' || page_id || '.JPG' WHEN 2 THEN 'host/p/' || page_id END AS path, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' ELSE 'image/gif' END AS mime FROM pages""")
def file_paths(spark, sf):
    p = Fixture("p", "pages", {"page_id": "page_id"})(spark, sf)
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("file:///a%20b/"), n, F.lit("+x.png"))).when(k == 1, F.concat(F.lit("plain/"), n, F.lit(".JPG"))).when(k == 2, F.concat(F.lit("FILE://host/p/"), n)).otherwise(F.lit("data:image/gif;base64,AA=="))
    decoder = F.when(k == 2, "WEBP").otherwise("")
    return p.select("page_id", identity.file_path(url).alias("path"), identity.mime(url, decoder, F.coalesce(identity.file_path(url), F.lit(""))).alias("mime"))


_CUBIC = "CASE WHEN t < 1 THEN (1.5 * t - 2.5) * t * t + 1 WHEN t < 2 THEN ((-0.5 * t + 2.5) * t - 4) * t + 2 ELSE 0 END"


def _weights(name: str, size: int, wide: float) -> str:
    """Bicubic weights of 8 places for ``size`` new ones."""
    return f"""{name} AS (SELECT o, n, trunc(c / sum(c) OVER (PARTITION BY o) * 4194304 + CASE WHEN c < 0 THEN -0.5 ELSE 0.5 END) AS w FROM (SELECT o, n, {_CUBIC} AS c FROM (SELECT o, n, abs(n + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {8 / size}::DOUBLE) / {wide}::DOUBLE AS t FROM range({size}) a(o), range(8) b(n))))"""


@query(f"""WITH p AS (SELECT vec_id, y, x, ((vec_id * 7 + (y * 8 + x) * 13) % 256)::DOUBLE AS v FROM embeddings, range(8) a(y), range(8) b(x)), {_weights("h", 5, 1.6)}, {_weights("u", 11, 1.0)},
a AS (SELECT vec_id, y, o AS x, greatest(0, least(255, floor((sum(v * w) + 2097152) / 4194304))) AS v FROM p JOIN h ON n = x GROUP BY ALL), b AS (SELECT vec_id, o AS y, x, greatest(0, least(255, floor((sum(v * w) + 2097152) / 4194304))) AS v FROM a JOIN u ON n = y GROUP BY ALL)
SELECT vec_id, y::INT AS y, sum(v * (x + 1))::BIGINT AS total FROM b GROUP BY ALL""")
def bicubic_resize(spark, sf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
        for batch in batches:
            ids = batch.column(0).to_numpy()
            made = [tensor.resize(((i * 7 + (y * 8 + x) * 13) % 256).astype(np.uint8)[:, :, None], 11, 5)[:, :, 0].astype(np.int64) @ np.arange(1, 6) for i in ids.tolist()]
            rows = pa.array(np.tile(np.arange(11, dtype=np.int32), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, 11)), rows, pa.array(np.concatenate(made) if made else [], pa.int64())], ["vec_id", "y", "total"])

    return Fixture("e", "embeddings", {"vec_id": "vec_id"})(spark, sf).mapInArrow(run, "vec_id long, y int, total long")


@query("SELECT vec_id, CASE vec_id % 5 WHEN 3 THEN 'ValueError: shape' WHEN 4 THEN 'ValueError: nbytes' END AS error, CASE WHEN vec_id % 5 < 3 THEN round(list_sum(embedding::DOUBLE[]), 4) END AS total FROM embeddings")
def tensor_files(spark, sf):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            content = []
            for i, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values, out = np.asarray(e, dtype=np.float32).reshape(8, 8), io.BytesIO()
                np.save(out, values)
                content.append(values.tobytes() if i % 5 == 1 else out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["vec_id", "content"])

    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(written, "vec_id long, content binary")
    k = F.col("vec_id") % 5
    files = rows.select(F.col("vec_id").cast("string").alias("path"), "content", F.when(k == 1, "raw").otherwise("npy").alias("format"), F.when(k == 3, F.array(F.lit(4), F.lit(16))).otherwise(F.array(F.lit(8), F.lit(8))).alias("shape"), F.lit("float32").alias("dtype"), F.when(k == 4, 255).otherwise(256).cast("long").alias("nbytes"))
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return media.load_tensors(files).select(F.col("path").cast("long").alias("vec_id"), "error", F.round(total, 4).alias("total"))


PLANNED = {"req": "o_custkey", "request_media_index": "CAST(o_orderkey AS INT)", "item_identity": "concat('i', CAST(o_orderkey AS VARCHAR(20)))", "placeholder_token_count": "CAST(o_orderkey % 9 + 1 AS INT)", "processor_signature": "'s'"}


@query("SELECT o_custkey AS req, o_orderkey::INT AS request_media_index, 'i' || o_orderkey AS item_identity, CASE WHEN o_orderkey % 2 = 0 THEN 'http' ELSE 'base64' END AS transport, 'k' || o_orderkey AS source_key, (o_orderkey % 9 + 1)::INT AS tokens, (o_orderkey % 5 + 1)::INT AS grid_h FROM orders WHERE o_orderkey % 3 <> 0")
def planned_serialization(spark, sf):
    planned = Fixture("p", "orders", PLANNED)(spark, sf)
    planned = planned.withColumn("image_grid_thw", F.array(F.lit(1), F.col("request_media_index") % 5 + 1, F.lit(2)))
    known = Fixture("d", "orders", {"req": "o_custkey", "request_media_index": "CAST(o_orderkey AS INT)", "transport": "CASE WHEN o_orderkey % 2 = 0 THEN 'http' ELSE 'base64' END", "source_key": "concat('k', CAST(o_orderkey AS VARCHAR(20)))"}, "o_orderkey % 3 <> 0")
    rows = T.serialized(planned, known(spark, sf), ["req", "request_media_index"])
    got = rows.select("req", payloads.decode(F.col("item"), payloads.PLANNED).alias("i"))
    return got.select("req", "i.request_media_index", "i.item_identity", "i.transport", "i.source_key", F.col("i.placeholder_token_count").alias("tokens"), F.col("i.image_grid_thw")[1].alias("grid_h"))


@query(f"WITH {SIDES_SQL}, r AS (SELECT doc_id, {resize_sql('h', 'w')[0]} AS rh, {resize_sql('h', 'w')[1]} AS rw FROM d) SELECT doc_id, rh, rw, CASE WHEN rh > 0 THEN 1 END::INT AS grid_t, CASE WHEN rh > 0 THEN greatest(1, rh // 14) END::INT AS grid_h, CASE WHEN rh > 0 THEN greatest(1, rw // 14) END::INT AS grid_w, CASE WHEN rh > 0 THEN greatest(1, greatest(1, rh // 14) * greatest(1, rw // 14) // 4) END::INT AS tokens FROM r")
def worker_schedule(spark, sf):
    d = Fixture("d", "documents", {"doc_id": "doc_id", "h": "CAST(doc_id * 37 % 3000 + 1 AS INT)", "w": "CAST(n_chars * 13 % 2800 + 1 AS INT)"})(spark, sf)
    return d.select("doc_id", geometry.scheduled(F.col("h"), F.col("w"), 14, 2, 2, 3136, 1_003_520).alias("i")).select("doc_id", "i.*")


@query("SELECT vec_id, 'k' || vec_id AS cache_key, 2::INT AS epoch FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, 'k' || vec_id, 1 FROM embeddings WHERE vec_id % 4 <> 0")
def evicted_payloads(spark, sf):
    rows = Fixture("e", "embeddings", {"vec_id": "vec_id", "cache_key": "concat('k', CAST(vec_id AS VARCHAR(20)))"})(spark, sf)
    held = rows.withColumn("epoch", F.explode(F.array(F.lit(1), F.lit(2))))
    gone = held.where("epoch = 2 and vec_id % 3 = 0 or epoch = 1 and vec_id % 4 = 0")
    return media.drop_evicted(held, gone).select("vec_id", "cache_key", "epoch")


@query()
def local_files(spark, sf):
    """Whole files as rows; their paths aren't known to SQL."""
    rows = media.files(spark, f"{sf}/region.parquet")
    return rows.select(F.substring_index("path", "/", -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
