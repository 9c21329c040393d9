"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one is made up only for local masters."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", path := tempfile.mkdtemp(prefix="loomline-"))
    return path


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and the file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession) -> str:
    """A path that nothing uses yet; what is written there goes when the driver's JVM ends."""
    target, fs = file_system(spark, path := f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}")
    fs.deleteOnExit(target)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df``, written once and read back: later jobs read files, which survive lost executors, not its lineage."""
    df.write.parquet(path := new_path(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)
