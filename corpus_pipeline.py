"""Documents to packed sequences: language ID, exact and near deduplication, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import exact_dedup, language_id, mixing, near_dedup, packing
from loomline.llm.common import save
from loomline.llm.queries import vocabulary


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that are taken by a column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with the columns they came with.

    Documents without a letter go (null, empty and blank texts among them). Null ids, langs and sources, repeated rows and
    further columns of any name are kept as they are. Where no language can be learned, as in an empty table, none is known.
    """
    pred, score = _free(docs, "lang_pred", "score")
    raw = docs.withColumn("text", F.col("text").cast("binary"))
    fields = ", ".join(f"`{c}` {t}" for c, t in raw.dtypes)
    judge = language_id.scorer(docs, language_id.fit(docs), docs.columns, (pred, score))
    found = raw.mapInArrow(judge, f"{fields}, {pred} string, {score} double").where(F.col(pred) != language_id.UNKNOWN)
    return found.withColumn("text", F.col("text").cast("string")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest doc_id, with the columns it came with.

    Null counts as the empty text, a null id loses to any other. Of rows that repeat both the id and the text any one
    stays. An empty table gives no rows.
    """
    sha, number, none = _free(docs, "text_sha256", "number", "none")
    key = [F.coalesce("doc_id", F.lit(0)).alias(number), F.col("doc_id").isNull().alias(none)]
    kept = exact_dedup.exact_groups(docs).where("kept").select(*key, F.col("text_sha256").alias(sha)).distinct()
    rows = docs.select("*", *key, F.sha2(F.coalesce("text", F.lit("")), 256).alias(sha))
    keys = [number, none, sha]
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest doc_id, with the columns it came with.

    Rows of one id are one document and stay or go together; null ids and texts without words stay. An empty table gives
    no rows.
    """
    (kept_id,) = _free(docs, "kept_id")
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks for, with the columns it came with.

    An empty source is a source of its own, null is another; rows without words add nothing to a size and draw like others
    of their source; rows that repeat id and size draw alike. An empty table gives no rows.
    """
    return mixing.emit(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their ids and their places in sequences; only doc_id and text are read.

    A null or empty text is one piece of one id, repeated rows and null ids are packed each. An empty table gives no rows.
    """
    return packing.pack(docs, vocabulary())


STAGES = [("language_id", languages), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: Trained models, consistent sampling and BPE have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
