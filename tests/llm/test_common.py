import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomline.llm import common as C
from loomline.llm import near_dedup


def test_slices_are_bounded_by_rows_and_bytes():
    texts = [b"x" * n for n in (5, 0, 30, 200, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    got = [p.column(0).to_pylist() for p in C.slices(batch, 0, 3, 100)]
    assert [t for p in got for t in p] == texts and [len(p) for p in got] == [3, 1, 3, 1]
    assert list(C.slices(batch.slice(0, 0), 0)) == []


def test_memory_of_long_texts():
    """256 texts of 1 MB go through words, hashes and shingles slice by slice, under 1 GB."""
    text = b" ".join(b"word%d" % (i % 9973) for i in range(120_000))[: 1 << 20]
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 256, pa.binary())], ["text"])
    tracemalloc.start()
    n = sum(len(near_dedup.shingles_of(p.column(0).to_pylist())) for p in C.slices(batch, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 256 and peak < 300 << 20


def test_hashes_do_not_depend_on_the_chunk(monkeypatch):
    texts = [b"some words of one text " * 40, b"and another " * 3]
    buf, start, stop, _ = C.words_of(texts)
    want = C.spelled(buf, start, stop)
    monkeypatch.setattr(C, "_CHUNK", 16)
    assert (C.spelled(buf, start, stop) == want).all() and len(np.unique(want)) == 7


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(C, "COMMON", 5)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 99, i) for i in range(60)] + [(None, 1)], "k long, v long")
    table = C.save(rows.where("k is not null and k <> 4").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")))
    got = sorted(map(tuple, C.hot_join(rows, table, "k", "n", 61).select("k", "v", "n", "top").collect()))
    assert got == sorted(map(tuple, rows.join(table, "k").select("k", "v", "n", "top").collect())) and len({g[0] for g in got}) == 7
    C.discard(table)
