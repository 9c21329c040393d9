"""Source plans: made, previewed, observed, fetched, published, and told.

A plan has one row an image: request_id, idx, decision, producer_rank, state, reason and the handle's cache_key and epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import identity

OWNED = ("FALLBACK_CLAIMED", "FALLBACK_LOCAL_DONE")


def observe(descriptors: DataFrame, entries: DataFrame) -> DataFrame:
    """The plan another rank has made, read off the state table; only requests with every image decided are returned."""
    e = entries.select("cache_key", F.col("state").alias("state"), F.col("claimed_by"), F.col("epoch").alias("epoch"))
    rows = descriptors.select("request_id", "idx", "cache_key").join(e, "cache_key", "left")
    rank = F.when(F.col("state").isin(*OWNED), identity.claimer_rank(F.col("claimed_by")))
    ready = F.coalesce(F.col("state") == "READY", F.lit(False))
    rows = rows.withColumn("producer_rank", rank).withColumn("_ok", (ready | F.col("producer_rank").isNotNull()).cast("int"))
    undecided = rows.where("_ok = 0").select("request_id").distinct()
    rows = rows.join(undecided, "request_id", "left_anti")
    return rows.select(
        "request_id", "idx", F.when(ready, "USE_SIDECAR").otherwise("FALLBACK").alias("decision"), "producer_rank", "state",
        F.when(ready, "ready_observed_from_manager").otherwise("fallback_observed_from_manager").alias("reason"), "cache_key", "epoch",
    )


def fail_open(descriptors: DataFrame, rank: int) -> DataFrame:
    """The plan where there is no manager: everything falls back here."""
    return descriptors.select("request_id", "idx", F.lit("FALLBACK").alias("decision"), F.lit(rank).alias("producer_rank"), F.lit("manager_unavailable_fail_open").alias("reason"))


def route(plan: DataFrame, descriptors: DataFrame, rank: int) -> DataFrame:
    """What becomes of each entry: fetched from the sidecar, fetched from the rank that has claimed it, or made here.

    A fallback entry without a descriptor is an error.
    """
    known = descriptors.select("request_id", "idx", F.lit(True).alias("_known"))
    rows = plan.join(known, ["request_id", "idx"], "left")
    sidecar = F.col("decision") == "USE_SIDECAR"
    remote = F.col("producer_rank").isNotNull() & (F.col("producer_rank") != rank)
    error = F.when(~sidecar & F.col("_known").isNull(), F.concat(F.lit("fallback descriptor missing for media index "), F.col("idx").cast("string")))
    step = F.when(sidecar, "fetch_ready").when(remote, "fetch_remote").otherwise("local_fallback")
    return rows.select(*plan.columns, F.when(error.isNull(), step).alias("step"), error.alias("error"))


def degraded(plan: DataFrame, descriptors: DataFrame, entries: DataFrame) -> DataFrame:
    """The batch after a peer's result didn't come: sidecar entries are fetched, all other images are made here.

    A sidecar entry whose result is gone is an error; entries without a descriptor are passed over.
    """
    rows = plan.join(descriptors.select("request_id", "idx"), ["request_id", "idx"], "left_semi")
    got = entries.where("state = 'READY' and cached").select("cache_key", "epoch", "nbytes")
    rows = rows.join(got, ["cache_key", "epoch"], "left")
    sidecar = F.col("decision") == "USE_SIDECAR"
    error = F.when(sidecar & F.col("nbytes").isNull(), F.concat(F.lit("sidecar artifact missing during degraded fetch for media index "), F.col("idx").cast("string")))
    step = F.when(sidecar & F.col("nbytes").isNotNull(), "sidecar").when(~sidecar, "local")
    return rows.select("request_id", "idx", step.alias("step"), F.when(sidecar, F.col("nbytes")).alias("nbytes"), error.alias("error"))


def may_degrade(world_size: Column, rank: Column, coordinator: Column, message: Column) -> Column:
    """Whether a timed-out remote fallback may be made here: on ranks other than the coordinator of several."""
    return (world_size > 1) & (rank != coordinator) & F.coalesce(message.rlike("remote fallback artifact (unavailable|missing)"), F.lit(False))


def to_publish(plan: DataFrame, artifacts: DataFrame, rank: int) -> DataFrame:
    """Results of images whose entry names this rank and has a handle, with that handle."""
    own = plan.where((F.col("producer_rank") == rank) & F.col("cache_key").isNotNull()).select("request_id", "idx", "cache_key", "epoch")
    return artifacts.join(own, ["request_id", "idx"])


def rebuild(features: DataFrame, entries: DataFrame) -> DataFrame:
    """Each request's plan from lookups alone: ``features(req, pos, modality, identifier)`` name image keys.

    A request with an unknown key has none; request_id and signature are the first row's.
    """
    keys = features.where("modality = 'image' and identifier <> ''").select("req", "pos", F.col("identifier").alias("cache_key"))
    rows = keys.join(entries.select("cache_key", "request_id", "epoch", "signature"), "cache_key", "left")
    whole = rows.groupBy("req").agg(
        F.bool_and(F.col("epoch").isNotNull()).alias("_all"), F.min_by("request_id", "pos").alias("request_id"),
        F.min_by("signature", "pos").alias("signature"), F.count("*").alias("prepared_image_count"),
    )
    return whole.where("_all").drop("_all").withColumn("reason", F.lit("reconstructed_from_manager_lookup"))


def diagnostics(plan: DataFrame, rank: int, near_wait: str, running_wait: str) -> DataFrame:
    """One row a request: entries by decision and place, by state and reason (maps by suffix), and the waits."""
    sidecar, fallback = F.col("decision") == "USE_SIDECAR", F.col("decision") == "FALLBACK"
    remote = fallback & F.col("producer_rank").isNotNull() & (F.col("producer_rank") != rank)
    near, running = F.max(near_wait), F.max(running_wait)
    return plan.groupBy("request_id").agg(
        F.count("*").alias("entry_count"), F.count_if(sidecar).alias("use_sidecar"), F.count_if(fallback).alias("fallback"),
        F.count_if(fallback & ~remote).alias("local_fallback"), F.count_if(remote).alias("remote_fallback"),
        near.alias("near_ready_wait_ms"), running.alias("running_ready_wait_ms"), (near + running).alias("reported_wait_ms"),
    )


def counts_by(plan: DataFrame, *columns: str) -> DataFrame:
    """Entries of each request by diagnostic suffix of the columns' values: request_id, name, n."""
    names = F.array(*(F.concat(F.lit(f"source_plan_{c}_"), identity.diagnostic_suffix(F.col(c))) for c in columns))
    return plan.select("request_id", F.explode(names).alias("name")).groupBy("request_id", "name").agg(F.count("*").alias("n"))


def debug(plan: DataFrame, only: list[int] | None = None) -> DataFrame:
    """``idx:decision:state:reason:rank=r`` of a request's entries, in order of idx, optionally of some indexes only."""
    rows = plan if only is None else plan.where(F.col("idx").isin(*only))
    text = F.concat_ws(":", F.col("idx").cast("string"), F.coalesce("decision", F.lit("none")), F.coalesce("state", F.lit("none")), F.coalesce("reason", F.lit("none")), F.concat(F.lit("rank="), F.coalesce(F.col("producer_rank").cast("string"), F.lit("-"))))
    rows = rows.where("idx is not null").groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("idx", text.alias("t")))).alias("r"))
    return rows.select("request_id", F.array_join(F.transform("r", lambda x: x["t"]), ",").alias("debug"))
