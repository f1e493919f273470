"""Streaming twins, drained over the driver tables; their oracles are the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold.operators import ingest as I
from quirefold.operators import ledger as L
from quirefold.plans import q_ingest, q_ledger
from quirefold.plans.fixtures import oracle, table
from quirefold.streaming import ingest as SI
from quirefold.streaming import ledger as SL
from quirefold.streaming.expiry import expiring_items
from quirefold.streaming.runner import drain, new_folder
from quirefold.streaming.store import upserted


def _replayed(s, df, name):
    """A derived table written out and opened again as a stream."""
    path = new_folder(s, name)
    df.write.parquet(path)
    return s.readStream.schema(df.schema).parquet(path)


def stream_state_counts(s, d):
    return upserted(L.state_counts(table(s, d, "fx_item", stream=True)), ["ws", "batch_id", "state"])


def stream_queue_depth(s, d):
    live = table(s, d, "fx_item", stream=True).groupBy("pool").agg(*[F.sum((F.col("state") == x).cast("bigint")).alias(x) for x in ("queued", "running")])
    return upserted(live, ["pool"])


def stream_lease_sweep(s, d):
    swept = L.lease_sweep(table(s, d, "fx_item", stream=True), q_ledger._now()).select(
        "ws", "id", "outcome", "state", F.coalesce("failure_code", F.lit("")).alias("failure_code"), F.col("fencing_token").isNull().alias("token_cleared"))
    return drain(swept, "lease_sweep")


def _events(s, d):
    return _replayed(s, table(s, d, "fx_event"), "events")


def stream_fenced_writes(s, d):
    return SL.fenced_writes(_events(s, d)).select("ws", "item_id", "seq", "kind", "verdict")


def stream_item_state_fold(s, d):
    return SL.item_state_fold(_events(s, d)).select(
        "ws", "item_id", "state", "attempts", F.coalesce("fencing_token", F.lit(-1)).alias("fencing_token"), F.coalesce("lease_owner", F.lit("")).alias("lease_owner"),
        F.coalesce(F.unix_millis("lease_expires_at"), F.lit(-1)).alias("lease_ms"), F.coalesce("failure_code", F.lit("")).alias("failure_code"))


def stream_lease_expiry(s, d):
    """Items whose heartbeats have stopped by the time of the last event, found by their timers."""
    events = _replayed(s, table(s, d, "fx_event").withColumn("seen_at", F.col("ts")), "events")
    out = expiring_items(events).select(
        "ws", "item_id", "state", "attempts", F.coalesce("fencing_token", F.lit(-1)).alias("fencing_token"), F.coalesce("outcome", F.lit("")).alias("outcome"),
        F.coalesce("failure_code", F.lit("")).alias("failure_code"))
    return out.where("outcome <> ''")


def stream_lease_extend(s, d):
    return SL.lease_extend(_events(s, d)).select("ws", "item_id", "gen_token", "held", "lost", F.unix_millis("lease_expires_at").alias("lease_ms"))


def stream_unique_predictions(s, d):
    p = table(s, d, "fx_prediction").select("id", "ws", "work_item_id", "candidate_id", "created_at", "key")
    again = p.where(F.col("key") % 5 == 0).withColumn("id", F.concat(F.col("id"), F.lit("-again")))
    return SL.unique_predictions(_replayed(s, p.unionByName(again), "predictions")).select("ws", "work_item_id", "candidate_id", "id")


def stream_micro_batches(s, d):
    return SL.micro_batches(table(s, d, "fx_arrival", stream=True), 4, 3_600_000)


def stream_register_assets(s, d):
    up = table(s, d, "fx_content", stream=True).select("ws", F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("arrival"), F.concat(F.lit("as"), "doc_id").alias("id"))
    return SI.register_assets(up, q_ingest._stored(s, d)).select("ws", "sha256", "id")


def stream_idempotent_batches(s, d):
    return SI.idempotent_batches(table(s, d, "fx_batch", stream=True)).select("ws", "idempotency_key", "id")


def stream_fan_out_items(s, d):
    """Pages arrive as a stream and meet the stored batches and releases."""
    b = table(s, d, "fx_batch").select("ws", F.col("id").alias("batch_id"), "release_id", "shadow_candidate_id", F.concat(F.lit("as"), F.expr("substring(id, 2)")).alias("asset_id"))
    r = table(s, d, "fx_release").select("ws", F.col("id").alias("release_id"), "candidate_id")
    pages = table(s, d, "fx_page", stream=True).select("ws", "asset_id", F.col("id").alias("page_id"))
    return drain(I.fan_out_items(pages.join(b, ["ws", "asset_id"]).join(r, ["ws", "release_id"])), "fan_out")


QUERIES = {f.__name__: f for f in (
    stream_state_counts, stream_queue_depth, stream_lease_sweep, stream_fenced_writes, stream_item_state_fold, stream_lease_expiry, stream_lease_extend, stream_unique_predictions,
    stream_micro_batches, stream_register_assets, stream_idempotent_batches, stream_fan_out_items)}

_Q = {
    "stream_lease_extend": q_ledger._Q["lease_extend"],
    "stream_unique_predictions": "SELECT ws, work_item_id, candidate_id, min(id) AS id FROM fx_prediction GROUP BY ALL",
    "stream_micro_batches": q_ledger._Q["micro_batches"],
    "stream_idempotent_batches": "SELECT ws, idempotency_key, arg_min(id, (created_at, id)) AS id FROM fx_batch WHERE idempotency_key IS NOT NULL GROUP BY ALL",
    "stream_lease_expiry": f"""WITH fold AS ({q_ledger._Q["item_state_fold"]}), clock AS (SELECT max(@ms(ts)) AS now FROM fx_event)
        SELECT ws, item_id, CASE WHEN attempts < {K.MAX_ATTEMPTS} THEN 'queued' ELSE 'failed' END AS state, attempts, CASE WHEN attempts < {K.MAX_ATTEMPTS} THEN -1 ELSE fencing_token END AS fencing_token,
          CASE WHEN attempts < {K.MAX_ATTEMPTS} THEN 'requeued' ELSE 'exhausted' END AS outcome, CASE WHEN attempts < {K.MAX_ATTEMPTS} THEN '' ELSE 'max_attempts' END AS failure_code
        FROM fold, clock WHERE state = 'running' AND lease_ms < now""",
    "stream_state_counts": q_ledger._Q["state_counts"], "stream_queue_depth": q_ledger._Q["queue_depth"], "stream_lease_sweep": q_ledger._Q["lease_sweep"],
    "stream_fenced_writes": q_ledger._Q["fenced_writes"], "stream_item_state_fold": q_ledger._Q["item_state_fold"],
    "stream_register_assets": q_ingest._Q["register_assets"], "stream_fan_out_items": q_ingest._Q["fan_out_items"],
}
ORACLES = {k: oracle(v) for k, v in _Q.items()}
