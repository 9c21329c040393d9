"""Queries of texts: exact token counts, and streamed responses read back line by line."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomline.operators import fitting
from loomline.plans.registry import query, table
from loomline.sources import lines, media
from loomline.tables import new_path

_SENTENCE, _WORD = r"[^.!?]+[.!?]*", r"[^\x20\x09-\x0D]+"
_TARGET = "20 + coalesce(n_chars, 0) % 180"


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, ({_TARGET})::INT AS target, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{_SENTENCE}'), lambda s: len(regexp_extract_all(s, '{_WORD}'))), lambda n: n > 0) AS sizes FROM documents),
r AS (SELECT doc_id, target, sizes, 0::BIGINT AS k, [0::BIGINT] AS sums FROM s
  UNION ALL SELECT doc_id, target, sizes, k + 1, list_distinct(list_concat(sums, list_filter(list_transform(sums, lambda x: x + sizes[k + 1]), lambda x: x <= target))) FROM r WHERE k < len(sizes) AND NOT list_contains(sums, target))
SELECT doc_id, target, bool_or(list_contains(sums, target)) AS possible, CASE WHEN bool_or(list_contains(sums, target)) THEN target::BIGINT ELSE 0 END AS tokens FROM r GROUP BY doc_id, target""")
def exact_texts(spark, sf):
    """Sentences of each document that have a number of words together, where any have."""
    docs = table(spark, sf, "documents")
    sentences = docs.select(F.col("doc_id").alias("grp"), F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_SENTENCE), 0)).alias("pos", "sentence"))
    pieces = sentences.withColumn("tokens", F.size(F.regexp_extract_all("sentence", F.lit(_WORD), 0)))
    told, picked = fitting.fit_exact(pieces, docs.selectExpr("doc_id AS grp", f"CAST({_TARGET} AS INT) AS target"))
    sums = picked.groupBy("grp").agg(F.sum("tokens").alias("tokens")).withColumnRenamed("grp", "_g")
    out = told.join(sums, F.col("grp").eqNullSafe(F.col("_g")), "left")
    return out.select(F.col("grp").alias("doc_id"), "target", "possible", F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"))


@query("""SELECT conv_id, count(*) FILTER (role = 'assistant' AND text <> '') AS tokens, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS text_sha256 FROM conversations GROUP BY 1""")
def response_lines(spark, sf):
    """Each conversation's answers as the event lines of a response, in files that a stream reads by offsets; what users say comes after the end.

    A file holds the lines of many responses, each line behind its response's id and a tab: files grow in number with the bytes, not
    with the responses.
    """
    turns = table(spark, sf, "conversations")
    kind = turns.schema["conv_id"].dataType
    event = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    told = turns.select("conv_id", F.when(answer, 0).otherwise(2).alias("part"), "turn", event.alias("line"))
    ends = turns.select("conv_id").distinct().select("conv_id", F.lit(1).alias("part"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("data: [DONE]").alias("line"))
    ordered = told.unionByName(ends).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_last("turn"), "line")
    folder = new_path(spark)
    ordered.select(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("\t"), "line")).write.option("maxRecordsPerFile", 0).text(f"{folder}/in", lineSep="\n\n")  # a response in one file
    spark.dataSource.register(lines.Lines)
    urls = spark.read.text(f"{folder}/in").inputFiles()  # the list of files that the stream reads
    out = spark.readStream.format("lines").option("urls", json.dumps(urls)).load().writeStream.format("parquet").option("path", f"{folder}/out")
    out.option("checkpointLocation", f"{folder}/state").trigger(once=True).start().awaitTermination()
    got = spark.read.schema("url string, offset long, line string").parquet(f"{folder}/out").where("line <> ''")
    own = F.nullif(F.substring_index("line", "\t", 1), F.lit("")).cast(kind)
    rows = got.select(own.alias("conv_id"), F.col("offset").alias("seq"), F.col("offset").cast("double").alias("at"), F.expr("substring(line, instr(line, '\t') + 1)").alias("line"))
    return media.streamed(rows, "conv_id").select("conv_id", "tokens", F.sha2("text", 256).alias("text_sha256"))
