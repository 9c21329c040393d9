"""Keyed tables under a log of commits: rows are replaced and evicted by key, and readers see whole versions.

A commit writes its rows and the keys it takes away into folders of their own and then puts one manifest in place, which names
the folders of that version. A writer that is lost leaves folders that no manifest names; one that finds its version taken puts the
same folders into the next. Rows are told by what later commits say of their key, so nothing is rewritten until ``vacuum``.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.tables import file_system

_PLACING = threading.Lock()


def _log(folder: str, version: int) -> str:
    return f"{folder}/log/{version:020d}.json"


def _read(spark: SparkSession, path: str) -> dict:
    target, fs = file_system(spark, path)
    stream = fs.open(target)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions there are, oldest first."""
    target, fs = file_system(spark, f"{folder}/log")
    if not fs.exists(target):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _place(spark: SparkSession, folder: str, manifest: dict) -> bool:
    """Puts the manifest of a version in place, whole; False if another writer was first.

    Renaming to a name that exists fails: in one step on HDFS, within one driver elsewhere.
    """
    sc = spark.sparkContext
    draft, fs = file_system(spark, f"{folder}/log/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(json.dumps(manifest).encode())
    out.close()
    target, _ = file_system(spark, _log(folder, manifest["version"]))
    with _PLACING:
        if fs.exists(target):
            fs.delete(draft, False)
            return False
        options = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Exception:
            if not fs.exists(target):
                raise
            fs.delete(draft, False)
            return False
    return True


def newest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """The manifest of a version, or of the newest; one of an empty table where there is none."""
    known = versions(spark, folder)
    if not known or version == 0:
        return {"version": 0, "keys": [], "parts": [], "tokens": []}
    return _read(spark, _log(folder, known[-1] if version is None else version))


def commit(spark: SparkSession, folder: str, keys: list[str], rows: DataFrame | None = None, evicted: DataFrame | None = None, token: str | None = None) -> int:
    """The version in which ``rows`` stand for all earlier rows of their keys, and the ``evicted`` keys have none.

    Keys are equal where all columns are, nulls too. Rows of one commit and key all stay; a key that is evicted and written by one
    commit is written. A token names the commit: the second with one does nothing, so a job may be run again.
    """
    name = uuid.uuid4().hex
    base = newest(spark, folder)
    if token is not None and token in base["tokens"]:
        return base["version"]
    part = {"rows": None, "gone": None}
    if rows is not None:
        rows.write.parquet(f"{folder}/data/{name}-rows")
        part["rows"] = f"{name}-rows"
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/data/{name}-rows")
    taken = [df.select(*keys) for df in (rows, evicted) if df is not None]
    if taken:
        gone = taken[0] if len(taken) == 1 else taken[0].unionByName(taken[1])
        gone.distinct().write.parquet(f"{folder}/data/{name}-gone")
        part["gone"] = f"{name}-gone"
    while True:
        base = newest(spark, folder)
        if token is not None and token in base["tokens"]:
            return base["version"]
        if base["keys"] not in ([], keys):
            raise ValueError(f"the table has the keys {base['keys']}")
        version = base["version"] + 1
        made = {"version": version, "keys": keys, "parts": [*base["parts"], part | {"version": version}], "tokens": [*base["tokens"], *([token] if token is not None else [])]}
        if _place(spark, folder, made):
            return version


def snapshot(spark: SparkSession, folder: str, schema: str, version: int | None = None) -> DataFrame:
    """The table's rows in a version, or in the newest; an empty table has none. Keys that later commits took are found by one anti join."""
    manifest = newest(spark, folder, version)

    def read(kind: str, columns) -> DataFrame | None:
        parts = [(p[kind], p["version"]) for p in manifest["parts"] if p[kind]]
        if not parts:
            return None
        paths = spark.createDataFrame(parts, "_part string, _version long")  # one a commit since the last vacuum
        rows = spark.read.schema(columns).parquet(*(f"{folder}/data/{p}" for p, _ in parts))
        rows = rows.withColumn("_part", F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]{32}-[a-z]+)/", 1))
        return rows.join(F.broadcast(paths), "_part").drop("_part")

    rows = read("rows", schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    keys = manifest["keys"]
    gone = read("gone", rows.select(*keys).schema)
    if gone is None:
        return rows.drop("_version")
    last = gone.groupBy(*keys).agg(F.max("_version").alias("_gone")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    later = F.col("_gone") > F.col("_version")
    for i, k in enumerate(keys):
        later = later & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(last, later, "left_anti").drop("_version")


def vacuum(spark: SparkSession, folder: str, schema: str, grace_ms: int = 86_400_000) -> int:
    """A version with the newest one's rows in one folder; older manifests go, and folders that no manifest names after ``grace_ms``.

    Readers of older versions need to be done by then. If another commit comes first nothing is changed but left for the next vacuum.
    """
    base = newest(spark, folder)
    if not base["version"]:
        return 0
    name = f"{uuid.uuid4().hex}-rows"
    snapshot(spark, folder, schema, base["version"]).write.parquet(f"{folder}/data/{name}")
    version = base["version"] + 1
    made = base | {"version": version, "parts": [{"rows": name, "gone": None, "version": version}]}
    if _place(spark, folder, made):
        base = made
    for old in versions(spark, folder):
        if old < base["version"]:
            target, fs = file_system(spark, _log(folder, old))
            fs.delete(target, False)
    named = {p[kind] for p in newest(spark, folder)["parts"] for kind in ("rows", "gone")}
    data, fs = file_system(spark, f"{folder}/data")
    now = spark.sparkContext._jvm.System.currentTimeMillis()
    for s in fs.listStatus(data):
        if s.getPath().getName() not in named and s.getModificationTime() <= now - grace_ms:
            fs.delete(s.getPath(), True)
    return base["version"]
