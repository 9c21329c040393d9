"""Timing maps and profiles: renaming, cleaning, merging, summing, summaries of events and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators.relational import sparse_summary

# The timings that are passed on, and the names they get.
TIMINGS = {
    "source": "worker_source_ms", "decode": "worker_decode_ms", "probe": "worker_probe_ms", "preprocess": "worker_preprocess_ms", "total": "worker_total_ms",
    "payload_local_file_write_ms": "payload_local_file_write_ms", "worker_ready_put_call_ms": "worker_ready_put_call_ms", "worker_ready_payload_nbytes": "worker_ready_payload_nbytes",
    "manager_ready_queue_to_apply_ms": "manager_ready_queue_to_apply_ms", "manager_ready_put_done_to_apply_ms": "manager_ready_put_done_to_apply_ms",
    "manager_ready_receive_to_apply_ms": "manager_ready_receive_to_apply_ms", "manager_ready_apply_total_ms": "manager_ready_apply_total_ms", "manager_cache_put_ms": "manager_cache_put_ms",
    "worker_to_manager_receive_ms": "worker_to_manager_receive_ms", "worker_to_manager_cache_done_ms": "worker_to_manager_cache_done_ms",
}
#: Elements of a list that are kept in a profile.
MOST = 128


def renamed(timings: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Rows of known timings with a number, under their diagnostic names."""
    names = F.create_map(*(F.lit(x) for pair in TIMINGS.items() for x in pair))
    rows = timings.withColumn(key, F.get(F.array(names[F.col(key)]), F.lit(0))).withColumn(value, F.expr(f"try_cast(`{value}` AS double)"))
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull())


def _number(text: Column) -> Column:
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text.cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def sanitized(profiles: DataFrame, key: str = "key", json: str = "json") -> DataFrame:
    """Rows (…, key, kind, text) of what may be kept of a profile's JSON values: booleans, finite numbers as doubles, strings, and lists of
    such, cut to MOST elements; everything else goes."""
    raw = F.trim(F.col(json))
    plain = _plain(raw)
    listed = F.from_json(raw, "array<string>")
    inner = F.filter(F.transform(F.slice(listed, 1, MOST), lambda x: x), lambda x: x.isNotNull() & ~x.startswith("{") & ~x.startswith("["))
    kind = F.when(raw.startswith("["), "list").when(raw.startswith('"'), "string").when(raw.isin("true", "false"), "bool").when(_number(raw).isNotNull(), "number")
    text = F.when(raw.startswith("["), F.to_json(inner)).otherwise(plain)
    return profiles.withColumns({"kind": kind, "text": text}).where("kind is not null").drop(json)


def _plain(raw: Column) -> Column:
    """The text of a JSON string, boolean or number; a number as a double's text."""
    word = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(_number(raw).isNotNull(), _number(raw).cast("string")).otherwise(word)


def merged(left: Column, right: Column) -> Column:
    """Two maps in one; of equal keys the right one's value counts."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def summed(rows: DataFrame, group: str, key: str = "key", value: str = "value") -> DataFrame:
    """Sum of each key over a group's rows; what isn't a number is passed over, and a missing key isn't 0."""
    number = F.expr(f"try_cast(`{value}` AS double)")
    return rows.withColumn("_v", number).where("_v is not null").groupBy(group, key).agg(F.sum("_v").alias("total"))


def payload_bytes(artifacts: DataFrame, group: str, nbytes: str = "nbytes") -> DataFrame:
    """Bytes of a group's payloads; unknown sizes are passed over."""
    return artifacts.groupBy(group).agg(F.coalesce(F.sum(nbytes), F.lit(0)).alias("payload_bytes"))


def worker_summary(rows: DataFrame, group: str, state: str, key: str, value: str) -> DataFrame:
    """Ready and failed workers of a group, joined to avg, max and sum of each timing, missing ones as 0."""
    states = rows.select(group, "row", state).distinct().groupBy(group).agg(F.count_if(F.col(state) == "READY").alias("ready"), F.count_if(F.col(state) == "FAILED").alias("failed"))
    return sparse_summary(rows, group, "row", key, value).join(states, group)


def prepare_total(manager: Column, api: Column) -> Column:
    """The total of a prepare: the manager's path if it took any time, else the whole of it."""
    return F.when(manager > 0, manager).otherwise(api)


def events(rows: DataFrame, label: str, start: str, end: str) -> DataFrame:
    """Events (label, started, ended, duration)."""
    return rows.select(F.col(label).alias("label"), F.col(start).alias("started"), F.col(end).alias("ended"), (F.col(end) - F.col(start)).alias("duration"))


def event_summary(rows: DataFrame) -> DataFrame:
    """calls, total, longest, first start, last end, mean and span of each label of ``events``."""
    return rows.groupBy("label").agg(
        F.count("*").alias("calls"), F.sum("duration").alias("total"), F.max("duration").alias("longest"), F.min("started").alias("first_start"),
        F.max("ended").alias("last_end"), F.avg("duration").alias("mean"), (F.max("ended") - F.min("started")).alias("span"),
    )


def ranked(summary: DataFrame) -> DataFrame:
    """Labels in report order: by falling total, then by first start, then by name. One row a label, in one task."""
    return summary.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "first_start", "label")))


def phases(rows: DataFrame, group: str) -> DataFrame:
    """Of ``rows(group, prepare_at, ready_at, fetched_at, nbytes)``: first and last ready and fetched since the prepare, and bytes."""
    start = F.min("prepare_at")
    return rows.groupBy(group).agg(
        (F.min("ready_at") - start).alias("first_ready"), (F.max("ready_at") - start).alias("all_ready"), (F.max("fetched_at") - F.max("ready_at")).alias("fetch"), F.coalesce(F.sum("nbytes"), F.lit(0)).alias("nbytes")
    )


def of_request(rows: DataFrame, group: str, request: object) -> DataFrame:
    """The profiles of one request."""
    return rows.where(F.col(group) == request)


def refreshed(rows: DataFrame, group: str, row: str, key: str, value: str) -> DataFrame:
    """The summary of a request's profiles with their number."""
    sizes = rows.groupBy(group).agg(F.countDistinct(row).alias("profiles"))
    return sparse_summary(rows, group, row, key, value).join(sizes, group)
