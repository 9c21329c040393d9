"""Queries of encoded images: streams and files whose sides, lengths and levels come from the documents' texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from loomline.functions import identity
from loomline.operators import images, relational
from loomline.plans.catalog import resize_sql
from loomline.plans.registry import query, table
from loomline.sources import blobs, commits, heads, media
from loomline.tables import new_path

#: Bytes of a comment segment.
PIECE = 60_000


def _two(n):
    return F.unhex(F.lpad(F.hex(n), 4, "0"))


def comment_streams(docs):
    """(doc_id, content): a JPEG header whose comments hold the whole text and whose frame has sides from the text's length; then the text as a scan."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length("raw")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(size / PIECE).cast("int") - 1))
    piece = lambda i: F.substring("raw", i * PIECE + 1, F.lit(PIECE))
    segment = lambda i: F.concat(F.unhex(F.lit("FFFE")), _two(F.octet_length(piece(i)) + 2), piece(i))
    comments = F.aggregate(F.transform(starts, segment), F.unhex(F.lit("FFD8")), lambda a, x: F.concat(a, x))
    frame = F.concat(F.unhex(F.lit("FFC0001108")), _two(size % 3000 + 1), _two(F.char_length("text") % 2000 + 1), F.unhex(F.lit("03")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), raw.alias("raw"))
    return rows.select("doc_id", F.concat(comments, frame, F.col("raw")).alias("content"))


@query(f"SELECT doc_id, (length(coalesce(text, '')) % 2000 + 1)::INT AS width, (strlen(coalesce(text, '')) % 3000 + 1)::INT AS height, true AS few FROM documents")
def probe_files(spark, sf):
    """Sides of image files, one a document, by ranged reads; ``few`` tells that at most a chunk a segment was read."""
    folder = new_path(spark)
    named = blobs.put(comment_streams(table(spark, sf, "documents")), "content", folder)
    spark.dataSource.register(heads.ImageHeads)
    found = spark.read.format("imageheads").load(folder).withColumn("name", F.regexp_extract("path", "([0-9a-f]{64})$", 1))
    few = F.col("bytes_read") <= heads.CHUNK * (F.floor(F.col("length") / PIECE) + 2)
    return named.join(found, "name").select("doc_id", "width", "height", few.alias("few"))


@query("SELECT doc_id, (length(coalesce(text, '')) % 2000 + 1)::INT AS width, (strlen(coalesce(text, '')) % 3000 + 1)::INT AS height FROM documents")
def probe_base64(spark, sf):
    """The same streams in data URLs, of which only the characters that are looked at are decoded."""
    coded = comment_streams(table(spark, sf, "documents")).select("doc_id", F.concat(F.lit("data:image/jpeg;base64,"), F.base64("content")).alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, height = zip(*(media.probe_base64(u) for u in batch.column(1).to_pylist())) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(width, pa.int32()), pa.array(height, pa.int32())], ["doc_id", "width", "height"])

    return coded.mapInArrow(run, "doc_id long, width int, height int")


def level_jpeg(height: int, width: int, level: int) -> bytes:
    """A baseline JPEG of one grey level: the first block's DC value, and no change after it. Sides are multiples of 8."""
    segment = lambda marker, data: b"\xff" + bytes([marker]) + (len(data) + 2).to_bytes(2, "big") + data
    value = level - 128  # a quantiser of 8 makes the DC value the level itself
    n = abs(value).bit_length()
    # Codes of four bits for the DC categories 0 to 8, one of one bit for an end of block.
    bits = f"{n:04b}" + (f"{value if value > 0 else value + (1 << n) - 1:0{n}b}" if n else "") + "0" + "00000" * (height // 8 * (width // 8) - 1)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    lengths = lambda *at: bytes(at.count(i) if isinstance(at, tuple) else 0 for i in range(1, 17))
    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), segment(0xDB, b"\0" + b"\x08" * 64), segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\1\1\x11\0"),
        segment(0xC4, b"\0" + lengths(*[4] * 9) + bytes(range(9))), segment(0xC4, b"\x10" + lengths(1) + b"\0"), segment(0xDA, b"\1\1\0\0\x3f\0"), scan, b"\xff\xd9",
    ])


@query(f"""WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, length(coalesce(text, '')) AS m FROM documents), s AS (SELECT doc_id, (n % 12 + 1)::INT * 8 AS h, (m % 10 + 1)::INT * 8 AS w, n % 256 AS level FROM d),
r AS (SELECT *, {resize_sql("h", "w")[0]} AS rh, {resize_sql("h", "w")[1]} AS rw FROM s)
SELECT doc_id, h AS orig_h, w AS orig_w, (rh // 14)::INT AS grid_h, (rw // 14)::INT AS grid_w, ((rh // 14) * (rw // 14) // 4)::INT AS tokens, round((level / 255.0 - 0.5) / 0.5, 4)::DOUBLE AS mean, 0.0::DOUBLE AS std FROM r""")
def jpeg_pipeline(spark, sf):
    """JPEGs in data URLs, sides and level from the text, through the whole way from transport to patches."""
    urls = _level_jpegs(spark, sf).select("doc_id", F.concat(F.lit("data:image/jpeg;base64,"), F.base64("content")).alias("url"))
    made = images.run_locally(media.data_url_bytes(urls, "url"), "doc_id")
    return made.select(F.col("key").cast("long").alias("doc_id"), "orig_h", "orig_w", "grid_h", "grid_w", "tokens", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def _level_jpegs(spark, sf):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf, "documents").select("doc_id", F.octet_length(text).alias("n"), F.char_length(text).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [level_jpeg((n % 12 + 1) * 8, (m % 10 + 1) * 8, n % 256) for n, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    return docs.mapInArrow(run, "doc_id long, content binary")


@query("""WITH t AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 3 WHEN label % 4 = 2 THEN NULL WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS epoch, embedding FROM embeddings)
SELECT vec_id, epoch::INT AS epoch, len(embedding)::INT AS n, (len(embedding) * 4)::BIGINT AS nbytes, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * epoch, 3) AS total FROM t WHERE epoch IS NOT NULL""")
def tensor_commits(spark, sf):
    """Tensors that are written, replaced, evicted, written again and vacuumed."""
    folder = new_path(spark)
    vectors = table(spark, sf, "embeddings")

    def put(rows, epoch):
        values = F.transform("embedding", lambda x: (x * epoch).cast("float"))
        media.write_tensors(rows.select(F.col("vec_id").cast("string").alias("cache_key"), F.lit(epoch).alias("epoch"), F.array(F.size("embedding")).alias("shape"), F.lit("float32").alias("dtype"), values.alias("values")), folder, token=f"epoch {epoch}")

    put(vectors, 1)
    put(vectors.where("vec_id % 3 = 0"), 2)
    media.evict_tensors(spark, folder, vectors.where("label % 4 = 2").select(F.col("vec_id").cast("string").alias("cache_key")))
    commits.vacuum(spark, folder, media.TENSORS, 0)
    put(vectors.where("vec_id % 5 = 0"), 3)
    put(vectors, 3)  # a second run of the same commit
    total = F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double")), 3)
    return media.read_tensors(spark, folder).where("error is null").select(F.col("cache_key").cast("long").alias("vec_id"), "epoch", F.col("shape")[0].alias("n"), "nbytes", total.alias("total"))


@query("""WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, substr(url, position('://' IN url) + 3) FROM pages UNION ALL SELECT page_id, left(html, 200) FROM pages)
SELECT page_id, url, CASE WHEN regexp_matches(url, '^https?://[^/?#]') THEN NULL ELSE 'INVALID_SOURCE' END AS source_error, CASE WHEN regexp_matches(url, '^https?://[^/?#]') THEN NULL ELSE 'INVALID_TRANSPORT' END AS transport_error FROM u""")
def source_errors(spark, sf):
    """What is wrong with pages' URLs, with their parts after the scheme and with markup taken for a URL."""
    pages = table(spark, sf, "pages")
    parts = F.array("url", F.substr("url", F.instr("url", "://") + 3), F.substring("html", 1, 200))
    rows = pages.select("page_id", F.explode(parts).alias("url"))
    return rows.select("page_id", "url", identity.http_source_error(F.col("url")).alias("source_error"), identity.transport_error(F.col("url"), F.lit(None).cast("string")).alias("transport_error"))


@query("SELECT unnest(['count', 'sides']) AS mode, 0::BIGINT AS mismatches, count(*) AS rows FROM documents")
def probed_against_decoded(spark, sf):
    """Sides from the header against sides of the decoded image, of JPEGs made of each text's lengths."""
    rows = _level_jpegs(spark, sf)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, height = zip(*(media.probe_bytes(c) for c in batch.column(1).to_pylist())) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(height, pa.int32()), pa.array(width, pa.int32())], ["doc_id", "height", "width"])

    fast = rows.mapInArrow(probe, "doc_id long, height int, width int")
    return relational.compare_modes(fast, images.decoded(rows, "content").select("doc_id", "height", "width"), ["doc_id"], {"count": [], "sides": ["height", "width"]})
