"""Work-ledger analytics: rollups, leases, fencing, claims, micro-batches, sweeps.

An event log holds facts (claim, requeue) and requests (heartbeat, complete, fail,
cancel). Each claim or requeue opens a *generation* of its item; a request counts only
when it carries the token of the generation it falls into and nothing ended that
generation before it.
"""

from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold.functions.times import plus_seconds
from quirefold.operators.ordering import HOT_ROWS, position, running_sums

TERMINAL = {"complete": "succeeded", "fail": "failed", "cancel": "cancelled"}


def _axis(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def state_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("ws", "batch_id", "state").agg(F.count("*").alias("n"))


def queue_depth(items: DataFrame) -> DataFrame:
    """Queued and running items per pool; every known pool has a row."""
    live = items.groupBy("pool").agg(*[F.sum((F.col("state") == s).cast("bigint")).alias(s) for s in ("queued", "running")])
    known = _axis(items, "pool", K.POOLS).join(live.where(F.col("pool").isin(K.POOLS)), "pool", "left").na.fill({"queued": 0, "running": 0})
    return known.unionByName(live.where(~F.col("pool").isin(K.POOLS)))


def batch_rollup(batches: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Status ladder from one aggregate per batch; only rows the ladder may still move."""
    st = F.col("state")
    seen = items.groupBy("ws", F.col("batch_id").alias("id")).agg(
        F.bool_or(st == "running").alias("_run"), F.bool_or(st.isin("queued", "running")).alias("_open"),
        F.bool_or(st == "failed").alias("_bad"), F.bool_or(st == "cancelled").alias("_cut"))
    live = batches.where(F.col("finished_at").isNull() | F.col("status").isin("queued", "running", "succeeded", "partial"))
    flag = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("_run", "_open", "_bad", "_cut")}
    status = (
        F.when(F.col("cancel_requested_at").isNotNull() & ~flag["_run"], "cancelled")
        .when(~flag["_open"] & flag["_bad"], "failed")
        .when(~flag["_open"] & flag["_cut"], "partial")
        .when(~flag["_open"], "succeeded")
        .when(flag["_run"], "running")
        .otherwise(F.col("status"))
    )
    ended = F.when(~flag["_open"], F.coalesce("finished_at", now))
    return live.join(seen, ["ws", "id"], "left").withColumns({"status": status, "finished_at": ended}).select(*batches.columns)


def lease_sweep(items: DataFrame, now: Column, max_attempts: int = K.MAX_ATTEMPTS) -> DataFrame:
    """Expired leases: back to the queue, or failed once the attempts are used up."""
    late = items.where((F.col("state") == "running") & (F.col("lease_expires_at") < now))
    again = F.col("attempts") < max_attempts
    return late.withColumns({
        "outcome": F.when(again, "requeued").otherwise("exhausted"),
        "state": F.when(again, "queued").otherwise("failed"),
        "failure_code": F.when(again, F.col("failure_code")).otherwise("max_attempts"),
        "claimed_at": F.when(~again, F.col("claimed_at")),
        "fencing_token": F.when(~again, F.col("fencing_token")),
        "lease_owner": F.lit(None).cast("string"),
        "lease_expires_at": F.lit(None).cast("timestamp"),
    })


def next_claims(items: DataFrame, n: int = K.CLAIM_BATCH, workers: int = 1) -> DataFrame:
    """The oldest queued items per pool, dealt to workers in runs of ``n``."""
    oldest = Window.partitionBy("pool").orderBy("enqueued_at", "id")
    return (
        items.where(F.col("state") == "queued").withColumn("rn", F.row_number().over(oldest))
        .where(F.col("rn") <= n * workers).withColumn("slot", F.floor((F.col("rn") - 1) / n))
    )


# -- event log ------------------------------------------------------------------------


def generations(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events with ``gen``, the number of claims and requeues up to and including them."""
    opens = F.col("kind").isin("claim", "requeue").cast("bigint")
    return running_sums(events, ["ws", "item_id"], [F.col("seq")], {"gen": opens}, hot_rows)


def fenced_writes(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every terminal request with a verdict: accepted, stale_token or not_running."""
    g = generations(events, hot_rows)
    key = ["ws", "item_id", "gen"]
    opened = g.where(F.col("kind").isin("claim", "requeue")).select(
        *key, F.when(F.col("kind") == "claim", F.col("token")).alias("gen_token"))
    writes = g.where(F.col("kind").isin(list(TERMINAL)))
    first = writes.groupBy(*key, "token").agg(F.min("seq").alias("first_seq"))
    held = F.coalesce(F.col("token") == F.col("gen_token"), F.lit(False))
    return (
        writes.join(first, [*key, "token"], "left").join(opened, key, "left")
        .withColumn("verdict", F.when(~held, "stale_token").when(F.col("seq") == F.col("first_seq"), "accepted").otherwise("not_running"))
        .drop("first_seq")
    )


def lease_extend(events: DataFrame, lease_s: int = K.LEASE_SECONDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per claim: heartbeats that still held the item, those that did not, and the lease end."""
    g = generations(events, hot_rows)
    key = ["ws", "item_id", "gen"]
    claims = g.where(F.col("kind") == "claim").select(*key, F.col("token").alias("gen_token"), F.col("ts").alias("claim_ts"))
    ended = (
        g.where(F.col("kind").isin(list(TERMINAL))).groupBy(*key, F.col("token").alias("gen_token")).agg(F.min("seq").alias("end_seq"))
    )
    beats = g.where(F.col("kind") == "heartbeat").select(*key, "token", "seq", "ts")
    live = claims.join(ended, [*key, "gen_token"], "left")
    ok = (F.col("token") == F.col("gen_token")) & (F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq")))
    ok = F.coalesce(ok, F.lit(False))
    return (
        live.join(beats, key, "left")
        .groupBy(*key, "gen_token")
        .agg(
            F.sum(ok.cast("bigint")).alias("held"),
            F.sum((~ok & F.col("seq").isNotNull()).cast("bigint")).alias("lost"),
            F.max(F.greatest(F.col("claim_ts"), F.when(ok, F.col("ts")))).alias("_last"),
        )
        .withColumn("lease_expires_at", plus_seconds(F.col("_last"), lease_s)).drop("_last")
    )


def item_state_fold(events: DataFrame, lease_s: int = K.LEASE_SECONDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The current row of every item: what its last generation came to."""
    g = generations(events, hot_rows)
    item = ["ws", "item_id"]
    last = g.groupBy(*item).agg(
        F.max("gen").alias("gen"), F.sum((F.col("kind") == "claim").cast("bigint")).alias("attempts"))
    current = g.join(last, [*item, "gen"])
    opened = current.where(F.col("kind").isin("claim", "requeue")).select(
        *item, F.when(F.col("kind") == "claim", F.col("token")).alias("fencing_token"),
        F.when(F.col("kind") == "claim", F.col("worker")).alias("owner"), F.col("ts").alias("opened_ts"))
    tagged = current.join(opened.select(*item, "fencing_token"), item).where(F.col("token") == F.col("fencing_token"))
    ends = tagged.where(F.col("kind").isin(list(TERMINAL))).groupBy(*item).agg(
        F.min(F.struct("seq", "kind", "code")).alias("_end"))
    beats = tagged.join(ends, item, "left").where(
        (F.col("kind") == "heartbeat") & (F.col("_end").isNull() | (F.col("seq") < F.col("_end.seq")))
    ).groupBy(*item).agg(F.max("ts").alias("_beat"))
    state = F.when(F.col("fencing_token").isNull(), "queued")
    for kind, name in TERMINAL.items():
        state = state.when(F.col("_end.kind") == kind, name)
    state = state.otherwise("running")
    full = last.join(opened, item, "left").join(ends, item, "left").join(beats, item, "left").withColumn("state", state)
    running = F.col("state") == "running"
    return full.select(
        *item, "state", "attempts", "fencing_token",
        F.when(running, F.col("owner")).alias("lease_owner"),
        F.when(running, plus_seconds(F.greatest("opened_ts", "_beat"), lease_s)).alias("lease_expires_at"),
        F.when(F.col("state") == "failed", F.col("_end.code")).when(F.col("state") == "cancelled", "cancelled").alias("failure_code"),
    )


# -- predictions, cancels, failures -----------------------------------------------------


def unique_predictions(predictions: DataFrame) -> DataFrame:
    """First prediction per (item, candidate) and how many there were."""
    rest = [c for c in predictions.columns if c not in ("ws", "work_item_id", "candidate_id", "id")]
    return (
        predictions.groupBy("ws", "work_item_id", "candidate_id")
        .agg(F.min(F.struct("id", *rest)).alias("_f"), F.count("*").alias("copies"))
        .select("ws", "work_item_id", "candidate_id", "copies", "_f.*")
    )


def cancel_fanout(batches: DataFrame, items: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches with their first cancel time, queued items now cancelled)."""
    asked = requests.groupBy("ws", "batch_id").agg(F.min("requested_at").alias("_asked"))
    marked = batches.join(asked.withColumnRenamed("batch_id", "id"), ["ws", "id"], "left").withColumn(
        "cancel_requested_at", F.coalesce("cancel_requested_at", "_asked")).select(*batches.columns)
    dropped = items.where(F.col("state") == "queued").join(asked, ["ws", "batch_id"], "left_semi").withColumns(
        {"state": F.lit("cancelled"), "failure_code": F.lit("cancelled")})
    return marked, dropped


def failure_breakdown(items: DataFrame) -> DataFrame:
    """Failures by code and pool with subtotals ('ALL')."""
    bad = items.where(F.col("failure_code").isNotNull())
    total = lambda c: F.when(F.grouping(c) == 1, "ALL").otherwise(F.col(c))
    return (
        bad.rollup("failure_code", "pool")
        .agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"),
             F.sum((F.col("attempts") >= K.MAX_ATTEMPTS).cast("bigint")).alias("at_cap"),
             F.sum((F.col("failure_code") == "admission_misprediction").cast("bigint")).alias("mispredictions"),
             total("failure_code").alias("code"), total("pool").alias("in_pool"))
        .select(F.col("code").alias("failure_code"), F.col("in_pool").alias("pool"), "n", "attempts", "at_cap", "mispredictions")
    )


def round_robin_groups(items: DataFrame, n: int, keys: Sequence[str], order: Sequence[Column], hot_rows: int = HOT_ROWS) -> DataFrame:
    return position(items, keys, order, "_pos", hot_rows).withColumn("lane", (F.col("_pos") - 1) % n).drop("_pos")


def over_hard_cap(peak: Column, cap: Column) -> Column:
    """Strictly above a positive cap; an unreadable peak or cap never trips it."""
    return F.coalesce((cap > 0) & (peak > cap), F.lit(False))


# -- micro-batches ------------------------------------------------------------------------


def _closings(at: np.ndarray, size: int, window_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """For a batch opened at each row: the row that closes it, and whether time did."""
    n = len(at)
    closed = np.minimum(np.arange(n) + size - 1, n)
    by_time = np.zeros(n, dtype=bool)
    for ahead in range(min(size - 2, n - 1), -1, -1):
        hit = np.zeros(n, dtype=bool)
        hit[: n - ahead] = at[ahead:] - at[: n - ahead] >= window_ms
        closed[hit] = np.nonzero(hit)[0] + ahead
        by_time[hit] = True
    return closed, by_time


def micro_batches(
    arrivals: DataFrame, size: int = K.MAX_BATCH, window_ms: int = K.BATCH_WINDOW_MS, key: str = "pool",
    chunk_rows: int = 65_536, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Close a batch at ``size`` items or at an arrival ``window_ms`` after its first; flush the rest.

    Where a batch starts depends on every arrival before it, but entering a run of
    ``chunk_rows`` arrivals there are only ``size`` places the first batch can start. So
    each chunk reports where each of them would leave off, those few numbers are chained
    per key, and the chunks are then cut independently.
    """
    ordered = position(arrivals, [key], [F.col("at_ms"), F.col("item")], "pos", hot_rows).withColumn("pos", F.col("pos") - 1)
    own = F.floor(F.col("pos") / chunk_rows)
    spill = F.when((F.col("pos") % chunk_rows < size - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    pieces = ordered.select(key, "pos", "at_ms", F.explode(spill).alias("chunk"))

    def prepared(pdf: pd.DataFrame):
        pdf = pdf.sort_values("pos")
        at = pdf["at_ms"].to_numpy()
        first = int(pdf["chunk"].iloc[0]) * chunk_rows
        return pdf, at, first, min(chunk_rows, len(at))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, first, inside = prepared(pdf)
        closed, _ = _closings(at, size, window_ms)
        leaves = []
        for start in range(size):
            i = start
            while i < inside:
                i = int(closed[i]) + 1
            leaves.append(max(0, i - chunk_rows))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "chunk": [int(pdf["chunk"].iloc[0])], "leaves": [leaves]})

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        enters, at = [], 0
        for leaves in pdf["leaves"]:
            enters.append(at)
            at = int(leaves[at])
        return pd.DataFrame({key: pdf[key], "chunk": pdf["chunk"], "enter": enters})

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, first, inside = prepared(pdf)
        closed, by_time = _closings(at, size, window_ms)
        rows, i = [], int(pdf["enter"].iloc[0])
        while i < inside:
            j = int(closed[i])
            why = "time" if by_time[i] else "size"
            if j >= len(at):
                j, why = len(at) - 1, "flush"
            rows.append((first + i, j - i + 1, why, int(at[j] - at[i]), int(at[i])))
            i = j + 1
        out = pd.DataFrame(rows, columns=["start_pos", "n", "closed_by", "waited_ms", "first_at_ms"])
        out.insert(0, key, pdf[key].iloc[0])
        return out

    kind = dict(arrivals.dtypes)[key]
    enters = (
        pieces.groupBy(key, "chunk").applyInPandas(exits, f"{key} {kind}, chunk bigint, leaves array<bigint>")
        .groupBy(key).applyInPandas(chained, f"{key} {kind}, chunk bigint, enter bigint")
    )
    return pieces.join(enters, [key, "chunk"]).groupBy(key, "chunk").applyInPandas(
        cut, f"{key} {kind}, start_pos bigint, n bigint, closed_by string, waited_ms bigint, first_at_ms bigint")


# -- sweeps ----------------------------------------------------------------------------------


def orphan_objects(listing: DataFrame, references: DataFrame, now: Column, grace_h: int = K.ORPHAN_GRACE_HOURS) -> DataFrame:
    """Objects no row refers to and that are past the grace period."""
    old = listing.where(F.col("mtime") <= plus_seconds(now, -grace_h * 3600))
    return old.join(references.select(F.col("object_key").alias("key")), "key", "left_anti")


def expired_workspaces(workspaces: DataFrame, dependents: dict[str, DataFrame], now: Column) -> DataFrame:
    """Expired workspaces per table, with the rows their removal takes along; tables that lose nothing show zero."""
    gone = workspaces.where(F.col("expires_at") < now).select(F.col("id").alias("ws"))
    everything = reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(name).alias("table"), "ws") for name, df in dependents.items()])
    per_space = everything.groupBy("table", "ws").agg(F.count("*").alias("_n")).join(gone, "ws", "left_semi")
    own = gone.select(F.lit("workspace").alias("table"), F.lit(1).cast("bigint").alias("_n"))
    axis = workspaces.sparkSession.createDataFrame([("workspace",), *[(n,) for n in dependents]], "table string")
    lost = per_space.select("table", "_n").unionByName(own).groupBy("table").agg(F.sum("_n").alias("rows"))
    return axis.join(lost, "table", "left").select("table", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"))


def dead_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    why = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") < now, "expired")
    return tokens.withColumn("reason", why).where(F.col("reason").isNotNull())


def sandbox_quota(workspaces: DataFrame, quota: int = K.SANDBOX_QUOTA) -> DataFrame:
    return workspaces.groupBy().agg(F.sum((F.col("kind") == "sandbox").cast("bigint")).alias("sandboxes")).select(
        "sandboxes", F.lit(quota).cast("bigint").alias("quota"), (F.col("sandboxes") >= quota).alias("full"))


def system_status(items: DataFrame, queue_limit: int = K.MAX_QUEUE_DEPTH, budget: int = K.WORKER_MEM_BUDGET) -> DataFrame:
    count = lambda test: F.sum(test.cast("bigint"))
    q, r = F.col("state") == "queued", F.col("state") == "running"
    return items.groupBy().agg(
        *[count(q & (F.col("pool") == p)).alias(f"queued_{p}") for p in K.POOLS],
        *[count(r & (F.col("pool") == p)).alias(f"running_{p}") for p in K.POOLS],
        count(q).alias("queued"), count(F.coalesce(F.col("failure_code"), F.lit("")) == "admission_misprediction").alias("mispredictions"),
    ).select("*", F.lit(queue_limit).cast("bigint").alias("queue_limit"), (F.col("queued") >= queue_limit).alias("queue_full"),
             F.lit(budget).cast("bigint").alias("worker_budget"), F.lit(K.SAFETY_MARGIN).alias("safety_margin"))
