"""Handles against the state table: lookups, claims, publishing, fetching, readiness.

A handle is (request_id, idx, cache_key, epoch); the state table has one row a cache_key with the same columns and
state, claimed_by, tokens (of the schedule item, null where there is none yet), cached, payload (a private result) and nbytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HANDLE = ("request_id", "idx", "cache_key", "epoch")
LIVE = ("QUEUED", "SIDECAR_RUNNING", "READY")
CLAIMABLE = ("QUEUED", "SIDECAR_RUNNING", "FAILED", "EXPIRED", "ABSENT")
#: States after which no metadata comes any more.
TERMINAL = ("READY", "FAILED", "EXPIRED", "FALLBACK_CLAIMED", "FALLBACK_LOCAL_DONE", "BYPASS")


def is_stale(left: str = "h", right: str = "e") -> Column:
    """Whether a handle differs from its entry in any of the four columns."""
    same = F.lit(True)
    for c in HANDLE:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return ~same


def _matched(handles: DataFrame, entries: DataFrame) -> DataFrame:
    return handles.alias("h").join(entries.alias("e"), F.col("h.cache_key") == F.col("e.cache_key"), "left")


def lookup(handles: DataFrame, entries: DataFrame) -> DataFrame:
    """Each handle with state, tokens, claimed_by and error: ABSENT where its key is unknown, ABSENT and ``stale_handle`` where it is out of date."""
    miss, stale = F.col("e.cache_key").isNull(), is_stale()
    got = lambda c: F.when(~miss & ~stale, F.col(f"e.{c}")).alias(c)
    state = F.when(miss | stale, "ABSENT").otherwise(F.col("e.state")).alias("state")
    return _matched(handles, entries).select("h.*", state, got("tokens"), got("claimed_by"), F.when(~miss & stale, "stale_handle").alias("error"))


def lookup_keys(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Each row of ``keys(pos, cache_key)``, repeated keys too, with the current epoch and state, or ``cache_key_not_found``."""
    miss = F.col("e.cache_key").isNull()
    rows = _matched(keys, entries)
    return rows.select("h.*", F.coalesce("e.state", F.lit("ABSENT")).alias("state"), F.col("e.epoch").alias("epoch"), F.when(miss, "cache_key_not_found").alias("error"))


def claim(handles: DataFrame, entries: DataFrame, claimer: Column) -> DataFrame:
    """What one claim of each handle by ``claimer`` gives: granted, state, new_epoch, owner, error. Unknown keys are granted."""
    miss, stale, state = F.col("e.cache_key").isNull(), is_stale(), F.col("e.state")
    fresh = ~miss & ~stale
    take = fresh & state.isin(*CLAIMABLE)
    again = fresh & (state == "FALLBACK_CLAIMED") & F.coalesce(F.col("e.claimed_by") == claimer, F.lit(False))
    return _matched(handles, entries).select(
        "h.*",
        (miss | take | again).alias("granted"),
        F.when(miss, "ABSENT").when(take, "FALLBACK_CLAIMED").otherwise(state).alias("state"),
        F.when(miss, F.col("h.epoch")).when(take, F.col("e.epoch") + 1).otherwise(F.col("e.epoch")).alias("new_epoch"),
        F.when(take, claimer).when(~miss, F.col("e.claimed_by")).alias("owner"),
        F.when(~miss & stale, "stale_handle").alias("error"),
    )


def publish(handles: DataFrame, entries: DataFrame, claimer: Column) -> DataFrame:
    """What publishing a local result by ``claimer`` gives: new_state and error. The claim is checked, not the state."""
    miss, stale = F.col("e.cache_key").isNull(), is_stale()
    other = ~F.coalesce(F.col("e.claimed_by") == claimer, F.lit(False))
    error = F.when(miss, "entry_not_found").when(stale, "stale_handle").when(other, "claim_mismatch")
    return _matched(handles, entries).select("h.*", F.when(error.isNull(), "FALLBACK_LOCAL_DONE").otherwise(F.col("e.state")).alias("new_state"), error.alias("error"))


def fetch(handles: DataFrame, entries: DataFrame) -> DataFrame:
    """The bytes each handle gets, and the entry's state after it: READY entries that left the cache expire."""
    ok = F.col("e.cache_key").isNotNull() & ~is_stale()
    ready = ok & (F.col("e.state") == "READY")
    own = ok & (F.col("e.state") == "FALLBACK_LOCAL_DONE") & F.col("e.payload")
    got = F.when((ready & F.col("e.cached")) | own, F.col("e.nbytes"))
    after = F.when(ready & ~F.col("e.cached"), "EXPIRED").otherwise(F.col("e.state"))
    return _matched(handles, entries).select("h.*", got.alias("nbytes"), after.alias("new_state"))


def refresh(entries: DataFrame) -> DataFrame:
    """READY entries whose cache row vanished are EXPIRED."""
    return entries.withColumn("state", F.when((F.col("state") == "READY") & ~F.col("cached"), "EXPIRED").otherwise(F.col("state")))


def wait_done(looked_up: DataFrame, group: str = "request_id") -> DataFrame:
    """Whether a request's wait for metadata, and its wait for final states, is over."""
    done = F.col("state").isin(*TERMINAL)
    return looked_up.groupBy(group).agg(F.bool_and(F.col("tokens").isNotNull() | done).alias("metadata_known"), F.bool_and(done).alias("all_final"), F.count_if(~done).alias("open"))


def stats(entries: DataFrame) -> DataFrame:
    """One row: entries by state, items and bytes of the cache, entries in flight."""
    of = lambda s: F.count_if(F.col("state") == s)
    names = {"queued": "QUEUED", "running": "SIDECAR_RUNNING", "ready": "READY", "failed": "FAILED", "expired": "EXPIRED"}
    flying = F.col("state").isin("QUEUED", "SIDECAR_RUNNING")
    return entries.agg(
        *(of(s).alias(n) for n, s in names.items()),
        F.count_if("cached").alias("cache_items"),
        F.coalesce(F.sum(F.when(F.col("cached"), F.col("nbytes"))), F.lit(0)).alias("cache_bytes"),
        F.count_if(flying).alias("in_flight"),
    )


def new_work(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """What preparing ``requests(pos, cache_key)`` submits: the first row of each key that is neither live nor in the cache."""
    first = requests.groupBy("cache_key").agg(F.min("pos").alias("pos"))
    known = entries.where(F.col("state").isin(*LIVE) | F.col("cached")).select("cache_key")
    return first.join(known, "cache_key", "left_anti").select("pos", "cache_key")
