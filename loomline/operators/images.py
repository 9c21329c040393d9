"""Images to patch tensors as one operator, and Spark's own decoder for files."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.images import Processor, decode
from loomline.sources import blobs
from loomline.tables import new_path

MADE = "key string, grid_t int, grid_h int, grid_w int, tokens int, orig_h int, orig_w int, shape array<int>, dtype string, nbytes long, mean double, std double, values array<float>, decode_ms double, preprocess_ms double, error string"


def decode_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files (JPEG too) as (origin, height, width, channels, pixels), pixels as RGB or grey bytes in row order."""
    rows = spark.read.format("image").load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = []
            for n, data in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                x = np.frombuffer(data, dtype=np.uint8).reshape(-1, n)
                pixels.append(np.ascontiguousarray(x[:, 2::-1] if n >= 3 else x).tobytes())
            channels = pa.array([3 if n >= 3 else n for n in batch.column(3).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), channels, pa.array(pixels, pa.binary())], ["origin", "height", "width", "channels", "pixels"])

    return rows.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "origin string, height int, width int, channels int, pixels binary")


def decoded(rows: DataFrame, content: str) -> DataFrame:
    """``rows`` with height, width, channels and data of their images in place of the bytes, which become files of the shared folder
    and are decoded by Spark's image source; ``content`` stays where that can't read them, and all five are null without bytes."""
    spark = rows.sparkSession
    folder = new_path(spark)
    named = blobs.put(rows.withColumn("_bytes", F.col(content)), "_bytes", folder).withColumnRenamed("name", "_name")
    files = spark.read.format("image").load(folder).select("image.*").where("height > 0")
    found = files.select(F.regexp_extract("origin", "([0-9a-f]{64})$", 1).alias("_name"), "height", "width", F.col("nChannels").alias("channels"), "data")
    return named.join(found, "_name", "left").drop("_name").withColumn(content, F.when(F.col("data").isNull(), F.col(content)))


#: Bytes of values that come in one batch, but for larger tensors.
BATCH = 8 << 20


def run_locally(images: DataFrame, key: str, content: str = "content", processor: Processor | None = None) -> DataFrame:
    """MADE rows of images in bytes: decoded, converted, resized, rescaled, normalised, cut into patches.

    JPEG, PNG and BMP bytes are decoded by Spark's image source, others that ``functions.images`` knows in the task. An image that can't be
    processed gives a row with an error and no values.
    """
    made = processor or Processor()
    schema = pa.schema([("key", pa.string()), *((c, pa.int32()) for c in ("grid_t", "grid_h", "grid_w", "tokens", "orig_h", "orig_w")), ("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("nbytes", pa.int64()), ("mean", pa.float64()), ("std", pa.float64()), ("values", pa.list_(pa.float32())), ("decode_ms", pa.float64()), ("preprocess_ms", pa.float64()), ("error", pa.string())])

    def one(name: str, content: bytes | None, height: int | None, width: int | None, n: int | None, data: bytes | None) -> dict:
        row = dict.fromkeys(schema.names) | {"key": name}
        try:
            began = time.perf_counter()
            if data is None:
                pixels = decode(content or b"")
            else:
                pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, n)
                pixels = pixels[:, :, [2, 1, 0, *range(3, n)]] if n >= 3 else pixels
            opened = time.perf_counter()
            patches, grid, tokens = made(pixels)
            flat = patches.ravel().astype(np.float64)
            return row | dict(zip(("grid_t", "grid_h", "grid_w"), grid, strict=True)) | {
                "tokens": tokens, "orig_h": pixels.shape[0], "orig_w": pixels.shape[1], "shape": list(patches.shape), "dtype": "float32", "nbytes": patches.size * 4, "mean": float(flat.mean()),
                "std": float(flat.std()), "values": patches.astype(np.float32).ravel(), "decode_ms": 1000 * (opened - began), "preprocess_ms": 1000 * (time.perf_counter() - opened),
            }
        except Exception as e:  # noqa: BLE001  a broken image is data here
            return row | {"error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(one(*(c[i].as_py() for c in batch.columns)))
                size += held[-1]["nbytes"] or 0
                if size > BATCH or len(held) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in held], f.type) for f in schema], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in held], f.type) for f in schema], schema=schema)

    rows = decoded(images.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")), "content")
    return rows.select("key", "content", "height", "width", "channels", "data").mapInArrow(run, MADE)


def patch_rows(made: DataFrame) -> DataFrame:
    """One row per element: key, row and column in the patch matrix, value."""
    rows = made.where("error is null").select("key", F.col("shape")[1].alias("_w"), F.posexplode("values").alias("_i", "value"))
    return rows.select("key", F.floor(F.col("_i") / F.col("_w")).cast("int").alias("row"), (F.col("_i") % F.col("_w")).alias("col"), "value")
