"""Explicit schemas of the nineteen ledger tables and their declared constraints.

``workspace_id`` is carried as ``ws`` throughout the package; readers rename it.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

from quirefold import constants as K

# Table layouts (workspace_id read as ws).
TABLES = {
    "workspace": "id STRING, name STRING, kind STRING, created_at TIMESTAMP, expires_at TIMESTAMP",
    "api_token": "id STRING, ws STRING, token_hash STRING, role STRING, created_at TIMESTAMP, expires_at TIMESTAMP, revoked_at TIMESTAMP",
    "asset": "id STRING, ws STRING, sha256 STRING, byte_size BIGINT, media_type STRING, object_key STRING, page_count INT, provenance STRING, license STRING, synthetic BOOLEAN, created_at TIMESTAMP",
    "page": "id STRING, ws STRING, asset_id STRING, page_index INT, width_px INT, height_px INT, render_dpi INT, object_key STRING, normalized STRING, created_at TIMESTAMP",
    "model_artifact": "id STRING, ws STRING, name STRING, repo_id STRING, revision STRING, format STRING, path STRING, sha256 STRING, byte_size BIGINT, license STRING, parent_sha STRING, exporter STRING, opset INT, torch_version STRING, ort_version STRING, created_at TIMESTAMP",
    "preprocess_profile": "id STRING, ws STRING, profile_hash STRING, body STRING, created_at TIMESTAMP",
    "runtime_profile": "id STRING, ws STRING, profile_hash STRING, body STRING, created_at TIMESTAMP",
    "candidate": "id STRING, ws STRING, name STRING, candidate_hash STRING, artifact_id STRING, preprocess_id STRING, runtime_id STRING, score_threshold DOUBLE, label_map_hash STRING, tile_enabled BOOLEAN, valid BOOLEAN, invalid_reason STRING, created_at TIMESTAMP",
    "dataset_version": "id STRING, ws STRING, name STRING, semver STRING, manifest_hash STRING, generator STRING, generator_version STRING, license STRING, synthetic BOOLEAN, counts STRING, created_at TIMESTAMP",
    "annotation": "id STRING, ws STRING, dataset_version_id STRING, page_id STRING, split STRING, class_name STRING, class_id INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, source STRING",
    "channel": "id STRING, ws STRING, name STRING, active_release_id STRING, version BIGINT, updated_at TIMESTAMP",
    "release": "id STRING, ws STRING, channel_id STRING, candidate_id STRING, previous_release_id STRING, action STRING, reason STRING, actor STRING, channel_version BIGINT, created_at TIMESTAMP",
    "batch": "id STRING, ws STRING, release_id STRING, shadow_candidate_id STRING, idempotency_key STRING, status STRING, total_items INT, synthetic BOOLEAN, cancel_requested_at TIMESTAMP, created_at TIMESTAMP, finished_at TIMESTAMP",
    "work_item": "id STRING, ws STRING, batch_id STRING, page_id STRING, candidate_id STRING, pool STRING, state STRING, role STRING, attempts INT, lease_owner STRING, lease_expires_at TIMESTAMP, fencing_token BIGINT, failure_code STRING, failure_detail STRING, received_at TIMESTAMP, enqueued_at TIMESTAMP, claimed_at TIMESTAMP, preprocess_start TIMESTAMP, preprocess_end TIMESTAMP, infer_start TIMESTAMP, infer_end TIMESTAMP, postprocess_end TIMESTAMP, persisted_at TIMESTAMP, enqueue_to_claim_ms DOUBLE, preprocess_ms DOUBLE, infer_ms DOUBLE, postprocess_ms DOUBLE, persist_ms DOUBLE, peak_rss BIGINT, created_at TIMESTAMP",
    "prediction": "id STRING, ws STRING, work_item_id STRING, candidate_id STRING, detections STRING, n_detections INT, raw_digest STRING, timings STRING, created_at TIMESTAMP",
    "evaluation_run": "id STRING, ws STRING, candidate_id STRING, reference_id STRING, status STRING, dataset_versions STRING, metrics STRING, gates STRING, code_sha STRING, env_manifest STRING, failure_detail STRING, created_at TIMESTAMP, finished_at TIMESTAMP",
    "benchmark_run": "id STRING, ws STRING, protocol_version STRING, status STRING, config_summary STRING, summary STRING, raw_object_key STRING, env_manifest STRING, created_at TIMESTAMP, finished_at TIMESTAMP",
    "host_calibration": "id STRING, ws STRING, candidate_hash STRING, host_fingerprint STRING, m0_bytes BIGINT, m_item_bytes DOUBLE, max_residual DOUBLE, samples STRING, measured_at TIMESTAMP",
    "audit_event": "id STRING, ws STRING, actor STRING, action STRING, subject_kind STRING, subject_id STRING, before_hash STRING, after_hash STRING, created_at TIMESTAMP",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def _one_of(values: list[str]) -> str:
    return "{c} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


# Declared checks, as (table, column, predicate over {c}).
CHECKS = [
    ("workspace", "kind", _one_of(K.WORKSPACE_KINDS)),
    ("api_token", "role", _one_of(K.TOKEN_ROLES)),
    ("asset", "byte_size", "{c} >= 0"),
    ("asset", "page_count", "{c} >= 0"),
    ("page", "page_index", "{c} >= 0"),
    ("page", "width_px", "{c} > 0"),
    ("page", "height_px", "{c} > 0"),
    ("page", "render_dpi", "{c} > 0"),
    ("model_artifact", "format", _one_of(K.ARTIFACT_FORMATS)),
    ("annotation", "split", _one_of(K.SPLITS)),
    ("annotation", "source", _one_of(K.ANNOTATION_SOURCES)),
    ("release", "action", _one_of(K.RELEASE_ACTIONS)),
    ("batch", "status", _one_of(K.BATCH_STATES)),
    ("work_item", "pool", _one_of(K.POOLS)),
    ("work_item", "state", _one_of(K.ITEM_STATES)),
    ("work_item", "role", _one_of(K.ITEM_ROLES)),
    ("evaluation_run", "status", _one_of(K.RUN_STATES)),
    ("benchmark_run", "status", _one_of(K.RUN_STATES)),
]
# Columns that may be NULL; every other column is required.
NULLABLE = {
    "workspace": ["expires_at"], "api_token": ["expires_at", "revoked_at"], "asset": ["license"], "page": ["normalized"],
    "model_artifact": ["parent_sha", "exporter", "opset", "torch_version", "ort_version"],
    "candidate": ["invalid_reason"], "channel": ["active_release_id"], "release": ["previous_release_id"],
    "batch": ["shadow_candidate_id", "idempotency_key", "cancel_requested_at", "finished_at"],
    "work_item": ["lease_owner", "lease_expires_at", "fencing_token", "failure_code", "failure_detail", "enqueued_at", "claimed_at",
                  "preprocess_start", "preprocess_end", "infer_start", "infer_end", "postprocess_end", "persisted_at",
                  "enqueue_to_claim_ms", "preprocess_ms", "infer_ms", "postprocess_ms", "persist_ms", "peak_rss"],
    "prediction": ["raw_digest", "timings"], "evaluation_run": ["reference_id", "metrics", "gates", "failure_detail", "finished_at"],
    "benchmark_run": ["summary", "raw_object_key", "finished_at"], "audit_event": ["before_hash", "after_hash"],
}
# Unique keys beyond (ws, id).
UNIQUE = [
    ("api_token", ["token_hash"]), ("asset", ["ws", "sha256"]), ("page", ["ws", "asset_id", "page_index"]),
    ("model_artifact", ["ws", "sha256"]), ("preprocess_profile", ["ws", "profile_hash"]), ("runtime_profile", ["ws", "profile_hash"]),
    ("candidate", ["ws", "candidate_hash"]), ("dataset_version", ["ws", "name", "semver"]), ("channel", ["ws", "name"]),
    ("batch", ["ws", "idempotency_key"]), ("prediction", ["work_item_id", "candidate_id"]),
    ("host_calibration", ["ws", "candidate_hash", "host_fingerprint"]),
]
# Foreign keys (child, column, parent); the workspace is part of each.
FOREIGN = [
    ("page", "asset_id", "asset"), ("candidate", "artifact_id", "model_artifact"), ("candidate", "preprocess_id", "preprocess_profile"),
    ("candidate", "runtime_id", "runtime_profile"), ("annotation", "dataset_version_id", "dataset_version"), ("annotation", "page_id", "page"),
    ("release", "channel_id", "channel"), ("release", "candidate_id", "candidate"), ("batch", "release_id", "release"),
    ("work_item", "batch_id", "batch"), ("work_item", "page_id", "page"), ("work_item", "candidate_id", "candidate"),
    ("prediction", "work_item_id", "work_item"), ("prediction", "candidate_id", "candidate"), ("evaluation_run", "candidate_id", "candidate"),
]
