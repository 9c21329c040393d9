"""Bytes from any transport as files in the shared folder, each content once, named by its digest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.tables import file_system, written


def put(rows: DataFrame, content: str, folder: str) -> DataFrame:
    """``rows`` with ``name`` in place of the bytes, the file's name in the folder; null where there are no bytes.

    A file is written under another name and moved, so that readers see it whole or not at all, and a repeated task changes nothing.
    """
    spark = rows.sparkSession
    target, fs = file_system(spark, folder)
    fs.mkdirs(target)
    kept = [c for c in rows.columns if c != content]
    schema = rows.select(*(F.col(f"`{c}`") for c in kept), F.lit(None).cast("string").alias("name")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pf.FileSystem.from_uri(folder)
        for batch in batches:
            *others, names, data = batch.columns
            for name, part in zip(names.to_pylist(), data.to_pylist(), strict=True):
                if name is None or store.get_file_info(f"{root}/{name}").type != pf.FileType.NotFound:
                    continue
                draft = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(part)
                store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([*others, names], schema.names)

    named = rows.select(*(F.col(f"`{c}`") for c in kept), F.sha2(F.col(content), 256).alias("name"), F.col(content))
    return written(named.mapInArrow(run, schema))
