"""Media sources and tensor sinks: files, data URLs, HTTP, JPEG headers, tensor tables."""

from __future__ import annotations

import base64
import io
import json
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import images
from loomline.functions.identity import data_url_payload
from loomline.sources import commits, heads
from loomline.sources.hosts import Connections
from loomline.tables import written


def files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(path)


def data_url_bytes(df: DataFrame, url: str) -> DataFrame:
    """``df`` with ``content``, the bytes of a base64 data URL; null where it isn't one."""
    return df.withColumn("content", F.try_to_binary(data_url_payload(F.col(url)), F.lit("base64")))


def _open(url: str) -> BinaryIO:
    import urllib.request

    return urllib.request.urlopen(url, timeout=30)


#: Bytes of content that come in one batch, but for larger ones.
BATCH = 8 << 20


def fetch(df: DataFrame, key: str, url: str, timeout_ms: int = 30_000, get: Callable[[str, list, int], bytes] | None = None, headers: str | None = None, timeout: str | None = None, per_host: int = 4) -> DataFrame:
    """``(key, content, error)`` of every row with a URL; each distinct request is made once.

    A host's requests are dealt to ``per_host`` lanes, each of which one task goes through over one connection, so a host has no more
    than that many in flight however many executors there are. ``headers`` names a column of array<struct<name, value>>, ``timeout`` one of
    milliseconds (null: ``timeout_ms``). A failed fetch gives rows with an error, not a failed job.
    """
    sent = F.col(headers) if headers else F.array().cast("array<struct<name: string, value: string>>")
    wait = F.coalesce(F.col(timeout).cast("int"), F.lit(timeout_ms)) if timeout else F.lit(timeout_ms)
    asked = df.where(F.col(url).isNotNull()).select(F.col(key).cast("string").alias("key"), F.struct(F.col(url).alias("url"), F.to_json(sent).alias("headers"), wait.alias("timeout")).alias("request"))
    schema = pa.schema([("request", pa.struct([("url", pa.string()), ("headers", pa.string()), ("timeout", pa.int32())])), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = Connections()
        made, held, size = get or hosts.get, [], 0
        try:
            for batch in batches:
                for r in batch.column(0).to_pylist():
                    content, error = None, None
                    try:
                        content = made(r["url"], [tuple(h.values()) for h in json.loads(r["headers"] or "[]")], r["timeout"])
                    except Exception as e:  # noqa: BLE001  any failure of a source is data here
                        error = f"{type(e).__name__}: {e}"
                    held.append((r, content, error))
                    size += len(content or b"")
                    if size > BATCH or len(held) >= 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types)], schema=schema)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types)], schema=schema)
        finally:
            hosts.close()

    host = F.lower(F.regexp_extract("request.url", r"^[^:/]+://(?:[^/?#]*@)?([^/?#]*)", 1))
    lanes = asked.select("request").distinct().withColumns({"host": host, "lane": F.pmod(F.xxhash64("request"), F.lit(per_host))})
    dealt = lanes.repartition("host", "lane").sortWithinPartitions("host", "lane").select("request")
    # Written once: what a join reads again must not be asked for again.
    got = written(dealt.mapInArrow(run, "request struct<url: string, headers: string, timeout: int>, content binary, error string"))
    return asked.join(got, "request").select("key", "content", "error")


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the first frame header; None where the bytes end before it.

    Bytes between segments are skipped up to the next marker. Bytes that don't begin a JPEG, and a segment length
    under 2, raise ValueError.
    """
    return heads.sides(heads.of_bytes(data))[0] if len(data) >= 4 else None


#: Bytes that are looked at at a time.
CHUNK = heads.CHUNK


def _probed(read: heads.Read, whole: Callable[[], bytes], chunk: int) -> tuple[int, int]:
    try:
        found, _ = heads.sides(read, chunk)
    except ValueError:
        found = None
    if found is None:
        height, width = images.decode(whole()).shape[:2]
        found = width, height
    return found


def probe_bytes(content: bytes, chunk: int = CHUNK) -> tuple[int, int]:
    """(width, height) from as little of the content as holds the frame header; by decoding it whole where there is none."""
    return _probed(heads.of_bytes(content), lambda: content, chunk)


def probe_base64(payload: str, chunk: int = CHUNK) -> tuple[int, int]:
    """The same from a data URL or bare base64, of which only the groups of four characters are decoded that are looked at."""
    coded = payload.split(",", 1)[1] if payload.startswith("data:") and "," in payload else payload
    return _probed(heads.of_base64(coded), lambda: base64.b64decode(coded + "=" * (-len(coded) % 4)), chunk)


def probe_urls(df: DataFrame, key: str, url: str, open_url: Callable[[str], BinaryIO] = _open, chunk: int = CHUNK) -> DataFrame:
    """``(key, width, height, bytes_read, error)`` of images behind URLs; a response is read up to its frame header and closed.

    What is no JPEG is an error, as it would have to be fetched whole. Rows without a URL have neither sides nor an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u in batch.column(1).to_pylist():
                row = None, None, 0, None
                if u is not None:
                    try:
                        with open_url(u) as got:
                            found, total = heads.sides(heads.of_stream(got), chunk)
                        row = (*found, total, None) if found else (None, None, total, "ValueError: no frame header")
                    except Exception as e:  # noqa: BLE001  any failure of a source is data here
                        row = None, None, 0, f"{type(e).__name__}: {e}"
                rows.append(row)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True))], ["key", "width", "height", "bytes_read", "error"])

    return df.select(F.col(key).cast("string").alias("key"), url).mapInArrow(run, "key string, width int, height int, bytes_read long, error string")


def probe_jpeg(df: DataFrame, key: str, content: str = "content", most: int = CHUNK) -> DataFrame:
    """``(key, width, height, error)`` from the first bytes of each row, or from all where those don't reach the frame header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c in batch.column(1).to_pylist():
                try:
                    rows.append((*probe_bytes(c, most), None) if c else (None, None, None))
                except Exception as e:  # noqa: BLE001  a broken image is data here
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
            width, height, error = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(error, pa.string())], ["key", "width", "height", "error"])

    return df.select(F.col(key).cast("string").alias("key"), content).mapInArrow(run, "key string, width int, height int, error string")


def probe_captures(df: DataFrame, key: str) -> DataFrame:
    """Sizes of captured images (key, transport, image_url, content) by their headers: of local and inline ones, none of HTTP."""
    inline = F.try_to_binary(data_url_payload(F.trim("image_url")), F.lit("base64"))
    rows = df.where(F.col("transport").isin("local_path", "base64"))
    return probe_jpeg(rows.select(key, F.when(F.col("transport") == "base64", inline).otherwise(F.col("content")).alias("content")), key)


def catalog(rows: DataFrame, needed: int, least: int = 900) -> DataFrame:
    """The first ``needed`` photos (pos, id, author, width, height, download_url) of a JSON array's elements ``(pos, item)``.

    Elements without an id, whole sides of ``least`` at least, and a URL are passed over. ``enough`` tells whether there are as many.
    """
    get = lambda k: F.get_json_object("item", f"$.{k}")
    photos = rows.select("pos", get("id").alias("id"), F.coalesce(get("author"), F.lit("unknown")).alias("author"), F.expr("try_cast(get_json_object(item, '$.width') AS int)").alias("width"), F.expr("try_cast(get_json_object(item, '$.height') AS int)").alias("height"), get("download_url").alias("download_url"))
    photos = photos.where(f"id is not null and download_url is not null and width >= {least} and height >= {least}").orderBy("pos").limit(needed)
    return photos.crossJoin(photos.agg((F.count("*") >= needed).alias("enough")))  # one row


def explicit_urls(lines: DataFrame, needed: int) -> DataFrame:
    """The first ``needed`` URLs of a file's lines ``(pos, line)``, without blank ones and comments, with ids by their order."""
    rows = lines.select("pos", F.trim("line").alias("url"), F.col("line").startswith("#").alias("comment")).where("url <> '' and not comment").orderBy("pos").limit(needed)
    rank = F.row_number().over(Window.orderBy("pos"))  # of at most `needed` rows
    return rows.select(F.concat(F.lit("explicit-"), F.lpad((rank - 1).cast("string"), 2, "0")).alias("id"), "url")


def streamed(lines: DataFrame, group: str) -> DataFrame:
    """First and last token time and the text of each response from its event lines ``(group, seq, at, line)``.

    Lines after ``[DONE]``, and lines that carry no content, count for nothing; a response without any has null times and no text. Lines of a null group are one response.
    """
    data = F.when(F.col("line").startswith("data: "), F.substr("line", F.lit(7)))
    ends = lines.where(data == "[DONE]").groupBy(F.col(group).alias("_group")).agg(F.min("seq").alias("_end"))
    content = F.get_json_object(data, "$.choices[0].delta.content")
    rows = lines.join(ends, F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("_c", F.when(F.col("_end").isNull() | (F.col("seq") < F.col("_end")), F.nullif(content, F.lit(""))))
    said = F.filter(F.sort_array(F.collect_list(F.struct("seq", "_c"))), lambda x: x["_c"].isNotNull())
    at = F.when(F.col("_c").isNotNull(), F.col("at"))
    return rows.groupBy(group).agg(F.min(at).alias("first_token_at"), F.max(at).alias("last_token_at"), F.count("_c").alias("tokens"), F.array_join(F.transform(said, lambda x: x["_c"]), "").alias("text"))


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a report's rows; one of more than ``most`` isn't a report and is refused."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    shown = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *(line(map(shown, r)) for r in got)])


#: Bytes of an element.
ITEM_BYTES = {"float32": 4, "float64": 8, "uint8": 1}


#: Columns of a table of tensors.
TENSORS = "cache_key string, epoch int, shape array<int>, dtype string, values array<float>, name string, nbytes long"


def write_tensors(tensors: DataFrame, path: str, token: str | None = None) -> DataFrame:
    """Tensors in a keyed table, with a name from (cache_key, epoch) and their bytes: they replace all of their cache keys' earlier ones.

    Readers see all of a write or nothing; a second one with the same token does nothing. Gives descriptors that point to the table:
    the rows without values, storage_kind ``local_file`` and the path.
    """
    name = F.sha2(F.concat_ws("|", "cache_key", F.col("epoch").cast("string")), 256)
    size = F.create_map(*(x for k, n in ITEM_BYTES.items() for x in (F.lit(k), F.lit(n))))[F.col("dtype")]
    named = tensors.withColumn("name", name).withColumn("nbytes", F.aggregate("shape", F.lit(1).cast("long"), lambda s, x: s * x) * size)
    commits.commit(tensors.sparkSession, path, ["cache_key"], named.select(*(f.split()[0] for f in TENSORS.split(", "))), token=token)
    return named.drop("values").withColumns({"storage_kind": F.lit("local_file"), "path": F.lit(path)})


def evict_tensors(spark: SparkSession, path: str, evicted: DataFrame, token: str | None = None) -> int:
    """The version of the table in which the ``evicted`` cache keys have no tensors; ``commits.vacuum`` deletes their files."""
    return commits.commit(spark, path, ["cache_key"], evicted=evicted, token=token)


def read_tensors(spark: SparkSession, path: str, dtype: str | None = None) -> DataFrame:
    """Tensors of the newest version with ``error``: set where the shape, the dtype or the byte count contradicts the values."""
    rows = commits.snapshot(spark, path, TENSORS)
    n = F.aggregate("shape", F.lit(1).cast("long"), lambda s, x: s * x)
    size = F.create_map(*(x for k, b in ITEM_BYTES.items() for x in (F.lit(k), F.lit(b))))[F.col("dtype")]
    wrong = size.isNull() if dtype is None else F.col("dtype") != dtype
    error = F.when(wrong, "dtype").when(F.size("values") != n, "shape").when(F.col("nbytes") != n * size, "nbytes")
    return rows.withColumn("error", error)


def load_tensors(files: DataFrame) -> DataFrame:
    """Tensors (path, values, error) of files ``(path, content, format, shape, dtype, nbytes)`` in ``npy`` or ``raw`` form.

    What contradicts the reference's shape, dtype or byte count, or a raw file's size, is an error.
    """

    def load(content: bytes, form: str, shape: list[int], dtype: str, nbytes: int) -> np.ndarray:
        want = int(np.prod(shape, dtype=np.int64)) * np.dtype(dtype).itemsize
        if nbytes != want:
            raise ValueError("nbytes")
        if form == "npy":
            got = np.load(io.BytesIO(content), allow_pickle=False)
        elif len(content) != want:
            raise ValueError("file size")
        else:
            got = np.frombuffer(content, dtype=dtype).reshape(shape)
        if list(got.shape) != list(shape):
            raise ValueError("shape")
        if got.dtype != np.dtype(dtype):
            raise ValueError("dtype")
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, *ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, error = None, None
                try:
                    values = load(*ref).ravel().astype(np.float32)
                except Exception as e:  # noqa: BLE001  a broken file is data here
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([values], pa.list_(pa.float32())), pa.array([error], pa.string())], ["path", "values", "error"])

    return files.select("path", "content", "format", "shape", "dtype", "nbytes").mapInArrow(run, "path string, values array<float>, error string")


def drop_evicted(tensors: DataFrame, evicted: DataFrame) -> DataFrame:
    """Tensors that stay when those of (cache_key, epoch) are evicted or replaced."""
    return tensors.join(evicted.select("cache_key", "epoch"), ["cache_key", "epoch"], "left_anti")
