"""Latency split: queue-inclusive, service and batch wait, per item and per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.times import delta_ms
from quirefold.operators.ordering import ranked_columns, ranked_values, rounded_rank

STAGES = ["preprocess_ms", "infer_ms", "postprocess_ms", "persist_ms"]


def item_timings(items: DataFrame) -> DataFrame:
    return items.withColumns({
        "queue_inclusive_ms": delta_ms(F.col("received_at"), F.col("persisted_at")),
        "service_ms": delta_ms(F.col("claimed_at"), F.col("persisted_at")),
        "batch_wait_ms": delta_ms(F.col("preprocess_end"), F.col("infer_start")),
    })


def pct_rounded_rank(df: DataFrame, group: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Percentile at index ``round(p * (n - 1))``, half to even."""
    return ranked_values(df, group, value, {name: rounded_rank(p) for name, p in quantiles.items()})


def batch_timings(items: DataFrame) -> DataFrame:
    """Succeeded items only; a metric without values is NULL."""
    done = item_timings(items.where(F.col("state") == "succeeded"))
    ranks = {"p50": rounded_rank(0.50), "p95": rounded_rank(0.95)}
    metrics = {"queue_inclusive": "queue_inclusive_ms", "service": "service_ms", "batch_wait": "batch_wait_ms"}
    plain = [
        *[F.round(F.avg(c), 2).alias(f"{c}_mean") for c in STAGES],
        F.max(F.when(F.col("peak_rss") > 0, F.col("peak_rss"))).alias("peak_rss_bytes_max"),
        F.count("*").alias("n_succeeded"),
    ]
    timed = ranked_columns(done, ["ws", "batch_id"], metrics, ranks, plain)
    return timed.withColumnsRenamed({f"{m}_{k}": f"{m}_{k}_ms" for m in metrics for k in ranks}).drop(*[f"{m}_n" for m in metrics])


def merge_timings(items: DataFrame, partial: DataFrame) -> DataFrame:
    """New stage timings overwrite old ones only where they are present."""
    new = partial.select("ws", "id", *[F.col(c).alias(f"_n_{c}") for c in STAGES])
    joined = items.join(new, ["ws", "id"], "left")
    return joined.withColumns({c: F.coalesce(f"_n_{c}", c) for c in STAGES}).select(*items.columns)


def latency_violations(timings: DataFrame, slack_ms: float = 1.0, wait_slack_ms: float = 50.0) -> DataFrame:
    """Service longer than queue-inclusive, or a difference that is not the queue wait."""
    wait = delta_ms(F.col("received_at"), F.col("claimed_at"))
    gap = F.col("queue_inclusive_ms") - F.col("service_ms")
    reason = F.when(F.col("service_ms") > F.col("queue_inclusive_ms") + slack_ms, "service_exceeds_total").when(
        F.abs(gap - wait) > wait_slack_ms, "wait_mismatch")
    return timings.withColumn("reason", reason).where(F.col("reason").isNotNull())


def batch_view(batches: DataFrame, releases: DataFrame, candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Batch with its release's candidate, the shadow candidate, item counts and timings."""
    rel = releases.select("ws", F.col("id").alias("release_id"), "candidate_id")
    name = candidates.select("ws", F.col("id").alias("candidate_id"), F.col("name").alias("candidate_name"))
    shadow = candidates.select("ws", F.col("id").alias("shadow_candidate_id"), F.col("name").alias("shadow_candidate_name"))
    counts = items.groupBy("ws", "batch_id").agg(*[
        F.sum((F.col("state") == s).cast("bigint")).alias(f"n_{s}") for s in ("queued", "running", "succeeded", "failed", "cancelled")
    ])
    out = batches.join(rel, ["ws", "release_id"]).join(name, ["ws", "candidate_id"], "left")
    # most batches have no shadow; they would all meet in one partition of the join
    plain = out.where(F.col("shadow_candidate_id").isNull()).withColumn("shadow_candidate_name", F.lit(None).cast("string"))
    out = out.where(F.col("shadow_candidate_id").isNotNull()).join(shadow, ["ws", "shadow_candidate_id"], "left").unionByName(plain)
    per_batch = counts.join(batch_timings(items).drop("n_succeeded"), ["ws", "batch_id"], "left").withColumnRenamed("batch_id", "id")
    return out.join(per_batch, ["ws", "id"], "left").withColumn("candidate_name", F.coalesce("candidate_name", F.lit("unknown")))


def item_view(paired: DataFrame, pages_with_assets: DataFrame, diff_counts: DataFrame) -> DataFrame:
    """Shadow-paired items with page size, provenance and diff counts; ``paired`` is read twice.

    Timings that ``paired`` brings along are kept.
    """
    page = pages_with_assets.select("ws", F.col("id").alias("page_id"), "width_px", "height_px", "provenance", "synthetic")
    timed = paired if "service_ms" in paired.columns else item_timings(paired)
    keys = ["ws", "id", "shadow_item_id"]
    counts = {f.name: F.lit(None).cast(f.dataType) for f in diff_counts.schema if f.name not in keys}
    # an item without a shadow has no differences and stays out of their join
    alone = timed.where(F.col("shadow_item_id").isNull()).withColumns(counts)
    counted = timed.where(F.col("shadow_item_id").isNotNull()).join(diff_counts, keys, "left").unionByName(alone)
    return counted.join(page, ["ws", "page_id"], "left")
