"""Ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold import schemas as S
from quirefold.operators import audit
from quirefold.operators import ledger as L
from quirefold.plans.fixtures import oracle, table

NOW = "2000-01-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _ms(c):
    return F.unix_millis(F.col(c))


def state_counts(s, d):
    return L.state_counts(table(s, d, "fx_item"))


def queue_depth(s, d):
    return L.queue_depth(table(s, d, "fx_item"))


def batch_rollup(s, d):
    return L.batch_rollup(table(s, d, "fx_batch"), table(s, d, "fx_item"), _now()).select(
        "ws", "id", "status", F.coalesce(_ms("finished_at"), F.lit(-1)).alias("finished_ms"))


def lease_sweep(s, d):
    return L.lease_sweep(table(s, d, "fx_item"), _now()).select(
        "ws", "id", "outcome", "state", F.coalesce("failure_code", F.lit("")).alias("failure_code"), F.col("fencing_token").isNull().alias("token_cleared"))


def next_claims(s, d):
    return L.next_claims(table(s, d, "fx_item"), 8, 25).select("pool", "id", F.col("slot").cast("bigint").alias("slot"))


def fenced_writes(s, d):
    return L.fenced_writes(table(s, d, "fx_event")).select("ws", "item_id", "seq", "kind", "verdict")


def unique_predictions(s, d):
    """Every stored prediction plus a redelivered copy of some: one survives per (item, candidate)."""
    p = table(s, d, "fx_prediction").select("id", "ws", "work_item_id", "candidate_id", "n_detections", "key")
    again = p.where(F.col("key") % 5 == 0).withColumn("id", F.concat(F.col("id"), F.lit("-again")))
    return L.unique_predictions(p.unionByName(again)).select("ws", "work_item_id", "candidate_id", "id", "copies")


def item_state_fold(s, d):
    return L.item_state_fold(table(s, d, "fx_event")).select(
        "ws", "item_id", "state", "attempts", F.coalesce("fencing_token", F.lit(-1)).alias("fencing_token"),
        F.coalesce("lease_owner", F.lit("")).alias("lease_owner"), F.coalesce(F.unix_millis("lease_expires_at"), F.lit(-1)).alias("lease_ms"),
        F.coalesce("failure_code", F.lit("")).alias("failure_code"))


def lease_extend(s, d):
    return L.lease_extend(table(s, d, "fx_event")).select("ws", "item_id", "gen_token", "held", "lost", F.unix_millis("lease_expires_at").alias("lease_ms"))


def _requests(s, d):
    b = table(s, d, "fx_batch").where(F.col("status") != "failed")
    return b.where(F.col("idempotency_key").isNull()).select("ws", F.col("id").alias("batch_id"), F.col("created_at").alias("requested_at"))


def cancel_fanout(s, d):
    marked, dropped = L.cancel_fanout(table(s, d, "fx_batch"), table(s, d, "fx_item"), _requests(s, d))
    n = dropped.groupBy("ws", F.col("batch_id").alias("id")).agg(F.count("*").alias("cancelled"))
    return marked.where(F.col("cancel_requested_at").isNotNull()).join(n, ["ws", "id"], "left").select(
        "ws", "id", _ms("cancel_requested_at").alias("cancel_ms"), F.coalesce("cancelled", F.lit(0).cast("bigint")).alias("cancelled"))


def failure_breakdown(s, d):
    return L.failure_breakdown(table(s, d, "fx_item"))


def round_robin_groups(s, d):
    return L.round_robin_groups(table(s, d, "fx_item"), 3, ["ws", "batch_id"], [F.col("enqueued_at"), F.col("id")]).select(
        "id", F.col("lane").cast("bigint").alias("lane"))


def micro_batches(s, d):
    return L.micro_batches(table(s, d, "fx_arrival"), 4, 3_600_000, chunk_rows=512)


def over_hard_cap(s, d):
    i = table(s, d, "fx_item")
    cap = F.when(F.col("pool") == "torch", F.lit(300_000_000)).otherwise(F.lit(0))
    return i.groupBy("pool").agg(F.count("*").alias("n"), F.sum(L.over_hard_cap(F.col("peak_rss"), cap).cast("bigint")).alias("over"))


AUDITED = {"workspace": "fx_workspace", "api_token": "fx_token", "asset": "fx_asset", "page": "fx_page", "model_artifact": "fx_artifact",
            "preprocess_profile": "fx_preprocess", "runtime_profile": "fx_runtime", "candidate": "fx_candidate", "channel": "fx_channel",
            "release": "fx_release", "batch": "fx_batch", "work_item": "fx_item", "prediction": "fx_prediction", "dataset_version": "fx_dataset",
            "annotation": "fx_annotation", "evaluation_run": "fx_evaluation", "benchmark_run": "fx_benchmark_run", "host_calibration": "fx_calibration",
            "audit_event": "fx_audit_event"}


def constraint_audit(s, d):
    return audit.constraint_audit({name: table(s, d, fx).select(*_columns(fx)) for name, fx in AUDITED.items()})


def orphan_objects(s, d):
    """Listing = every page render plus a stale copy per asset; only the unreferenced old ones go."""
    pages, assets = table(s, d, "fx_page"), table(s, d, "fx_asset")
    listing = pages.select(F.col("object_key").alias("key"), F.col("created_at").alias("mtime")).unionByName(
        assets.select(F.concat(F.lit("tmp/"), F.col("id")).alias("key"), F.col("created_at").alias("mtime")))
    kept = pages.where(F.col("page_index") < 3).select("object_key").unionByName(assets.select("object_key"))
    return L.orphan_objects(listing, kept, F.lit("1996-01-01").cast("timestamp")).select("key")


def expired_workspaces(s, d):
    w = table(s, d, "fx_workspace")
    rest = {name: table(s, d, fx) for name, fx in AUDITED.items() if name != "workspace"}
    return L.expired_workspaces(w, rest, F.lit("2024-01-03").cast("timestamp"))


def dead_tokens(s, d):
    return L.dead_tokens(table(s, d, "fx_token"), _now()).groupBy("reason", "role").agg(F.count("*").alias("n"))


def sandbox_quota(s, d):
    return L.sandbox_quota(table(s, d, "fx_workspace"))


def system_status(s, d):
    return L.system_status(table(s, d, "fx_item"))


QUERIES = {f.__name__: f for f in (
    state_counts, queue_depth, batch_rollup, lease_sweep, next_claims, fenced_writes, unique_predictions, item_state_fold, lease_extend,
    cancel_fanout, failure_breakdown, round_robin_groups, micro_batches, over_hard_cap, constraint_audit, orphan_objects,
    expired_workspaces, dead_tokens, sandbox_quota, system_status)}

# An independent reading of the event log: for each request, look back for the opener.
_GEN = """opens AS (SELECT ws, item_id, seq, kind, CASE WHEN kind = 'claim' THEN token END AS token, worker, ts FROM fx_event WHERE kind IN ('claim', 'requeue')),
  seen AS (SELECT e.*, o.seq AS oseq, o.token AS otoken FROM fx_event e ASOF LEFT JOIN opens o ON e.ws = o.ws AND e.item_id = o.item_id AND e.seq >= o.seq),
  w AS (SELECT *, coalesce(token = otoken, false) AS holds FROM seen WHERE kind IN ('complete', 'fail', 'cancel')),
  wr AS (SELECT *, row_number() OVER (PARTITION BY ws, item_id, oseq, holds ORDER BY seq) AS rn FROM w),
  ends AS (SELECT * FROM wr WHERE holds AND rn = 1)"""


def _audit_sql() -> str:
    parts = []
    for name, fx in AUDITED.items():
        cols = [c.strip().split()[0] for c in S.TABLES[name].split(",")]
        have = _columns(fx)
        for t, c, test in S.CHECKS:
            if t == name and c in have:
                parts.append(f"SELECT '{name}.{c} check' AS \"constraint\", count(*) FILTER (NOT ({test.format(c=c)})) AS violations FROM {fx}")
        for c in cols:
            if c in have and c not in S.NULLABLE.get(name, []):
                parts.append(f"SELECT '{name}.{c} not null', count(*) FILTER ({c} IS NULL) FROM {fx}")
        keys = [k for t, k in S.UNIQUE if t == name and set(k) <= set(have)] + [["ws", "id"] if "ws" in have else ["id"]]
        for k in keys:
            cond = " AND ".join(f"{c} IS NOT NULL" for c in k)
            parts.append(f"SELECT '{name}({', '.join(k)}) unique', count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM {fx} WHERE {cond} GROUP BY {', '.join(k)})")
    for child, c, parent in S.FOREIGN:
        if c in _columns(AUDITED[child]):
            a, b = AUDITED[child], AUDITED[parent]
            parts.append(f"SELECT '{child}.{c} -> {parent}', count(*) FROM {a} x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {b} y WHERE y.ws = x.ws AND y.id = x.{c})")
    for name, fx in AUDITED.items():
        if name != "workspace":
            parts.append(f"SELECT '{name}.ws -> workspace', count(*) FROM {fx} x WHERE ws IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_workspace y WHERE y.id = x.ws)")
    return " UNION ALL ".join(parts)


def _columns(fx: str) -> list[str]:
    return _COLUMNS[fx].split()


# declared columns each derived table carries
_COLUMNS = {
    "fx_workspace": "id name kind created_at expires_at",
    "fx_token": "id ws token_hash role expires_at revoked_at",
    "fx_asset": "id ws sha256 byte_size media_type object_key page_count provenance synthetic created_at",
    "fx_page": "id ws asset_id page_index width_px height_px render_dpi object_key created_at",
    "fx_artifact": "id ws name format path sha256 repo_id revision",
    "fx_preprocess": "id ws profile_hash body",
    "fx_runtime": "id ws profile_hash body",
    "fx_candidate": "id ws name candidate_hash artifact_id preprocess_id runtime_id score_threshold tile_enabled valid invalid_reason created_at",
    "fx_channel": "id ws name active_release_id version",
    "fx_release": "id ws channel_id candidate_id previous_release_id action reason channel_version created_at",
    "fx_batch": "id ws release_id shadow_candidate_id idempotency_key status total_items synthetic cancel_requested_at created_at finished_at",
    "fx_item": "id ws batch_id page_id candidate_id pool state role attempts lease_owner lease_expires_at fencing_token failure_code received_at "
               "enqueued_at claimed_at preprocess_end infer_start persisted_at preprocess_ms infer_ms postprocess_ms persist_ms peak_rss",
    "fx_prediction": "id ws work_item_id candidate_id detections n_detections created_at",
    "fx_dataset": "id ws name semver manifest_hash synthetic created_at",
    "fx_annotation": "id ws dataset_version_id page_id split class_name class_id x1 y1 x2 y2",
    "fx_evaluation": "id ws candidate_id status gates metrics created_at",
    "fx_benchmark_run": "id ws protocol_version status config_summary summary raw_object_key env_manifest created_at finished_at",
    "fx_calibration": "id ws candidate_hash host_fingerprint m0_bytes m_item_bytes max_residual samples measured_at",
    "fx_audit_event": "id ws actor action subject_kind subject_id before_hash after_hash created_at",
}

_Q = {
    "state_counts": "SELECT ws, batch_id, state, count(*) AS n FROM fx_item GROUP BY ALL",
    "queue_depth": "SELECT pool, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'running') AS running FROM fx_item GROUP BY pool",
    "batch_rollup": f"""WITH f AS (SELECT b.*, EXISTS (SELECT 1 FROM fx_item w WHERE w.ws = b.ws AND w.batch_id = b.id AND state = 'running') AS run,
        EXISTS (SELECT 1 FROM fx_item w WHERE w.ws = b.ws AND w.batch_id = b.id AND state IN ('queued', 'running')) AS op,
        EXISTS (SELECT 1 FROM fx_item w WHERE w.ws = b.ws AND w.batch_id = b.id AND state = 'failed') AS bad,
        EXISTS (SELECT 1 FROM fx_item w WHERE w.ws = b.ws AND w.batch_id = b.id AND state = 'cancelled') AS cut FROM fx_batch b
        WHERE finished_at IS NULL OR status IN ('queued', 'running', 'succeeded', 'partial'))
      SELECT ws, id, CASE WHEN cancel_requested_at IS NOT NULL AND NOT run THEN 'cancelled' WHEN NOT op AND bad THEN 'failed' WHEN NOT op AND cut THEN 'partial'
        WHEN NOT op THEN 'succeeded' WHEN run THEN 'running' ELSE status END AS status,
        CASE WHEN NOT op THEN @ms(coalesce(finished_at, TIMESTAMP '{NOW}')) ELSE -1 END AS finished_ms FROM f""",
    "lease_sweep": f"""SELECT ws, id, CASE WHEN attempts < 3 THEN 'requeued' ELSE 'exhausted' END AS outcome, CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS state,
        CASE WHEN attempts < 3 THEN coalesce(failure_code, '') ELSE 'max_attempts' END AS failure_code, attempts < 3 AS token_cleared
        FROM fx_item WHERE state = 'running' AND lease_expires_at < TIMESTAMP '{NOW}'""",
    "next_claims": """SELECT pool, id, (rn - 1) // 8 AS slot FROM (SELECT pool, id, row_number() OVER (PARTITION BY pool ORDER BY enqueued_at, id) AS rn FROM fx_item WHERE state = 'queued') z WHERE rn <= 200""",
    "fenced_writes": f"WITH {_GEN} SELECT ws, item_id, seq, kind, CASE WHEN NOT holds THEN 'stale_token' WHEN rn = 1 THEN 'accepted' ELSE 'not_running' END AS verdict FROM wr",
    "unique_predictions": """WITH a AS (SELECT id, ws, work_item_id, candidate_id FROM fx_prediction UNION ALL SELECT concat(id, '-again'), ws, work_item_id, candidate_id FROM fx_prediction WHERE key % 5 = 0)
        SELECT ws, work_item_id, candidate_id, min(id) AS id, count(*) AS copies FROM a GROUP BY ALL""",
    "item_state_fold": f"""WITH {_GEN},
        item AS (SELECT ws, item_id, count(*) FILTER (kind = 'claim') AS attempts FROM fx_event GROUP BY ALL),
        lasto AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ws, item_id ORDER BY seq DESC) AS r FROM opens) z WHERE r = 1),
        cur AS (SELECT i.ws, i.item_id, i.attempts, o.seq AS oseq, o.token, o.worker, o.ts AS ots, e.kind AS ekind, e.code AS ecode, e.seq AS eseq
                FROM item i LEFT JOIN lasto o ON i.ws = o.ws AND i.item_id = o.item_id LEFT JOIN ends e ON e.ws = o.ws AND e.item_id = o.item_id AND e.oseq = o.seq),
        beat AS (SELECT c.ws, c.item_id, max(e.ts) AS bts FROM cur c JOIN fx_event e ON e.ws = c.ws AND e.item_id = c.item_id AND e.kind = 'heartbeat' AND e.token = c.token AND e.seq > c.oseq AND (c.eseq IS NULL OR e.seq < c.eseq) GROUP BY ALL),
        st AS (SELECT c.*, bts, CASE WHEN token IS NULL THEN 'queued' WHEN ekind = 'complete' THEN 'succeeded' WHEN ekind = 'fail' THEN 'failed' WHEN ekind = 'cancel' THEN 'cancelled' ELSE 'running' END AS state
               FROM cur c LEFT JOIN beat USING (ws, item_id))
      SELECT ws, item_id, state, attempts, coalesce(token, -1) AS fencing_token, CASE WHEN state = 'running' THEN worker ELSE '' END AS lease_owner,
        CASE WHEN state = 'running' THEN @ms(greatest(ots, coalesce(bts, ots))) + 60000 ELSE -1 END AS lease_ms,
        CASE WHEN state = 'failed' THEN coalesce(ecode, '') WHEN state = 'cancelled' THEN 'cancelled' ELSE '' END AS failure_code FROM st""",
    "lease_extend": f"""WITH {_GEN},
        c AS (SELECT o.ws, o.item_id, o.seq AS oseq, o.token, o.ts, e.seq AS eseq FROM opens o LEFT JOIN ends e ON e.ws = o.ws AND e.item_id = o.item_id AND e.oseq = o.seq WHERE o.kind = 'claim'),
        b AS (SELECT c.*, s.seq AS bseq, s.ts AS bts, coalesce(s.token = c.token AND (eseq IS NULL OR s.seq < eseq), false) AS ok FROM c LEFT JOIN seen s ON s.ws = c.ws AND s.item_id = c.item_id AND s.oseq = c.oseq AND s.kind = 'heartbeat')
      SELECT ws, item_id, token AS gen_token, count(*) FILTER (ok) AS held, count(*) FILTER (NOT ok AND bseq IS NOT NULL) AS lost,
        @ms(max(CASE WHEN ok THEN greatest(ts, bts) ELSE ts END)) + 60000 AS lease_ms FROM b GROUP BY ws, item_id, token, oseq""",
    "cancel_fanout": """WITH r AS (SELECT ws, id, min(created_at) AS asked FROM fx_batch WHERE status <> 'failed' AND idempotency_key IS NULL GROUP BY ALL),
        n AS (SELECT ws, batch_id, count(*) AS n FROM fx_item WHERE state = 'queued' AND (ws, batch_id) IN (SELECT ws, id FROM r) GROUP BY ALL)
      SELECT b.ws, b.id, @ms(coalesce(cancel_requested_at, asked)) AS cancel_ms, coalesce(n, 0) AS cancelled FROM fx_batch b LEFT JOIN r ON r.ws = b.ws AND r.id = b.id
      LEFT JOIN n ON n.ws = b.ws AND n.batch_id = b.id WHERE coalesce(cancel_requested_at, asked) IS NOT NULL""",
    "failure_breakdown": """SELECT CASE WHEN grouping(failure_code) = 1 THEN 'ALL' ELSE failure_code END AS failure_code, CASE WHEN grouping(pool) = 1 THEN 'ALL' ELSE pool END AS pool,
        count(*) AS n, sum(attempts)::BIGINT AS attempts, count(*) FILTER (attempts >= 3) AS at_cap, count(*) FILTER (failure_code = 'admission_misprediction') AS mispredictions
        FROM fx_item WHERE failure_code IS NOT NULL GROUP BY ROLLUP (failure_code, pool)""",
    "round_robin_groups": "SELECT id, (row_number() OVER (PARTITION BY ws, batch_id ORDER BY enqueued_at, id) - 1) % 3 AS lane FROM fx_item",
    "micro_batches": """WITH RECURSIVE n AS (SELECT pool, at_ms, row_number() OVER (PARTITION BY pool ORDER BY at_ms, item) - 1 AS pos FROM fx_arrival),
        hop AS (SELECT a.pool, a.pos, a.at_ms, min(CASE WHEN b.pos - a.pos = 3 OR b.at_ms - a.at_ms >= 3600000 THEN b.pos END) AS close, max(b.pos) AS lastpos
                FROM n a JOIN n b ON a.pool = b.pool AND b.pos BETWEEN a.pos AND a.pos + 3 GROUP BY ALL),
        run(pool, pos) AS (SELECT DISTINCT pool, 0::BIGINT FROM n UNION ALL SELECT r.pool, h.close + 1 FROM run r JOIN hop h ON h.pool = r.pool AND h.pos = r.pos WHERE h.close IS NOT NULL)
      SELECT h.pool, h.pos AS start_pos, coalesce(close, lastpos) - h.pos + 1 AS n, CASE WHEN close IS NULL THEN 'flush' WHEN close - h.pos = 3 THEN 'size' ELSE 'time' END AS closed_by,
        e.at_ms - h.at_ms AS waited_ms, h.at_ms AS first_at_ms FROM run r JOIN hop h ON h.pool = r.pool AND h.pos = r.pos JOIN n e ON e.pool = h.pool AND e.pos = coalesce(close, lastpos)""",
    "over_hard_cap": "SELECT pool, count(*) AS n, count(*) FILTER (pool = 'torch' AND peak_rss > 300000000) AS over FROM fx_item GROUP BY pool",
    "constraint_audit": _audit_sql(),
    "orphan_objects": """WITH l AS (SELECT object_key AS key, created_at AS mtime FROM fx_page UNION ALL SELECT concat('tmp/', id), created_at FROM fx_asset)
        SELECT key FROM l WHERE mtime <= TIMESTAMP '1995-12-31 00:00:00' AND NOT EXISTS (SELECT 1 FROM fx_page p WHERE p.page_index < 3 AND p.object_key = key) AND NOT EXISTS (SELECT 1 FROM fx_asset a WHERE a.object_key = key)""",
    "expired_workspaces": "WITH gone AS (SELECT id FROM fx_workspace WHERE expires_at < TIMESTAMP '2024-01-03 00:00:00') SELECT 'workspace' AS \"table\", count(*) AS rows FROM gone" + "".join(
        f" UNION ALL SELECT '{name}', count(*) FROM {fx} WHERE ws IN (SELECT id FROM gone)" for name, fx in AUDITED.items() if name != "workspace"),
    "dead_tokens": f"SELECT CASE WHEN revoked_at IS NOT NULL THEN 'revoked' ELSE 'expired' END AS reason, role, count(*) AS n FROM fx_token WHERE revoked_at IS NOT NULL OR expires_at < TIMESTAMP '{NOW}' GROUP BY ALL",
    "sandbox_quota": "SELECT count(*) FILTER (kind = 'sandbox') AS sandboxes, 200::BIGINT AS quota, count(*) FILTER (kind = 'sandbox') >= 200 AS \"full\" FROM fx_workspace",
    "system_status": f"""SELECT count(*) FILTER (state = 'queued' AND pool = 'torch') AS queued_torch, count(*) FILTER (state = 'queued' AND pool = 'onnxruntime') AS queued_onnxruntime,
        count(*) FILTER (state = 'running' AND pool = 'torch') AS running_torch, count(*) FILTER (state = 'running' AND pool = 'onnxruntime') AS running_onnxruntime,
        count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (failure_code = 'admission_misprediction') AS mispredictions, 500::BIGINT AS queue_limit,
        count(*) FILTER (state = 'queued') >= 500 AS queue_full, {K.WORKER_MEM_BUDGET}::BIGINT AS worker_budget, 0.15::DOUBLE AS safety_margin FROM fx_item""",
}
ORACLES = {k: oracle(v) for k, v in _Q.items()}
