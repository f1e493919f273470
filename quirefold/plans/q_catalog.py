"""Catalogue lookups, pagination and JSON columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions.jsoncols import decode, detection_rows, encode_detections
from quirefold.operators import catalog as C
from quirefold.plans.fixtures import oracle, table
from quirefold.sources import readers as R


def decode_detections(s, d):
    p = table(s, d, "fx_prediction").select("ws", "work_item_id", "detections")
    return detection_rows(p, "detections", ["ws", "work_item_id"]).select(
        "work_item_id", F.col("pos").cast("bigint").alias("pos"), F.col("class_id").cast("bigint").alias("class_id"), "label", "score", "x1", "y1", "x2", "y2")


def encode_round_trip(s, d):
    """Detections written back to JSON text and read again give the same rows."""
    rows = detection_rows(table(s, d, "fx_prediction"), "detections", ["ws", "work_item_id"])
    again = detection_rows(encode_detections(rows, ["ws", "work_item_id"]), "detections", ["ws", "work_item_id"])
    return again.groupBy("ws", "label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score_sum"), F.sum("x2").alias("x2_sum"))


def decode_json_columns(s, d):
    e = table(s, d, "fx_evaluation")
    gates = decode("gates", "array<struct<gate:string,passed:boolean>>")
    metrics = decode("metrics", "struct<operating_threshold:double>")
    return e.select("id", metrics["operating_threshold"].alias("threshold"), F.explode(gates).alias("g")).select("id", "threshold", "g.gate", "g.passed")


def label_map(s, d):
    """One id2label object per document language group, exploded to (class_id, label)."""
    conf = table(s, d, "part").select("p_partkey", F.concat(
        F.lit('{"id2label":{"0":"'), F.col("p_brand"), F.lit('","10":"'), F.col("p_type"), F.lit('","2":"'), F.col("p_name"), F.lit('"}}')).alias("config"))
    return R.label_map(conf, "config", ["p_partkey"]).select("p_partkey", F.col("class_id").cast("bigint").alias("class_id"), "label")


def scoped(s, d):
    return C.scoped(table(s, d, "fx_item"), "w1").groupBy("state").agg(F.count("*").alias("n"))


def page_with_asset(s, d):
    return C.page_with_asset(table(s, d, "fx_page"), table(s, d, "fx_asset")).select("id", "sha256", "provenance", "synthetic")


def list_items_page(s, d):
    return C.list_page(C.scoped(table(s, d, "fx_item"), "w1"), "i1", 800).select("id", "state")


def recent_batches(s, d):
    return C.recent(C.scoped(table(s, d, "fx_batch"), "w2"), 60).select("id", "status")


def release_history(s, d):
    return C.release_history(table(s, d, "fx_release"), table(s, d, "fx_candidate"), 50).select(
        "channel_id", "id", F.col("rank").cast("bigint").alias("rank"), F.coalesce("candidate_name", F.lit("unknown")).alias("candidate_name"))


def latest_dataset_version(s, d):
    return C.latest_dataset_version(table(s, d, "fx_dataset")).select("ws", "name", "id", "semver")


def latest_evaluation(s, d):
    return C.latest_evaluation(table(s, d, "fx_evaluation")).select("ws", "candidate_id", "id")


def object_keys_for(s, d):
    wanted = table(s, d, "fx_item").where(F.col("state") == "queued").select("ws", "page_id")
    return C.object_keys_for(table(s, d, "fx_page"), wanted)


def dataset_page_ids(s, d):
    return C.dataset_page_ids(table(s, d, "fx_truth"), "synth-clean", "test")


def list_datasets(s, d):
    return table(s, d, "fx_dataset").orderBy("ws", "name", "semver", "id").select("ws", "name", "semver", "id")


def list_candidates(s, d):
    return table(s, d, "fx_candidate").orderBy("ws", "created_at", "id").select("ws", "id", "name")


def visible_class_counts(s, d):
    return C.visible_class_counts(table(s, d, "fx_pred_all"), 0.5, ["ws"])


QUERIES = {f.__name__: f for f in (
    decode_detections, encode_round_trip, decode_json_columns, label_map, scoped, page_with_asset, list_items_page, recent_batches, release_history,
    latest_dataset_version, latest_evaluation, object_keys_for, dataset_page_ids, list_datasets, list_candidates, visible_class_counts)}

_DET = """dets AS (SELECT ws, work_item_id, pos, CAST(json_extract(e, '$.class_id') AS BIGINT) AS class_id, json_extract_string(e, '$.label') AS label, CAST(json_extract(e, '$.score') AS DOUBLE) AS score,
    CAST(json_extract(e, '$.box[0]') AS DOUBLE) AS x1, CAST(json_extract(e, '$.box[1]') AS DOUBLE) AS y1, CAST(json_extract(e, '$.box[2]') AS DOUBLE) AS x2, CAST(json_extract(e, '$.box[3]') AS DOUBLE) AS y2
  FROM (SELECT ws, work_item_id, unnest(js) AS e, generate_subscripts(js, 1) - 1 AS pos FROM (SELECT ws, work_item_id, CAST(json_extract(detections, '$[*]') AS JSON[]) AS js FROM fx_prediction WHERE json_valid(detections)) a) b)"""

ORACLES = {k: oracle(v) for k, v in {
    "decode_detections": f"WITH {_DET} SELECT work_item_id, pos, class_id, label, score, x1, y1, x2, y2 FROM dets",
    "encode_round_trip": f"WITH {_DET} SELECT ws, label, count(*) AS n, round(sum(score), 4) AS score_sum, sum(x2) AS x2_sum FROM dets GROUP BY ws, label",
    "decode_json_columns": """SELECT id, CAST(json_extract(metrics, '$.operating_threshold') AS DOUBLE) AS threshold, json_extract_string(g, '$.gate') AS gate, CAST(json_extract(g, '$.passed') AS BOOLEAN) AS passed
        FROM (SELECT id, metrics, unnest(CAST(json_extract(gates, '$[*]') AS JSON[])) AS g FROM fx_evaluation) z""",
    "label_map": "SELECT p_partkey, 0::BIGINT AS class_id, p_brand AS label FROM part UNION ALL SELECT p_partkey, 10, p_type FROM part UNION ALL SELECT p_partkey, 2, p_name FROM part",
    "scoped": "SELECT state, count(*) AS n FROM fx_item WHERE ws = 'w1' GROUP BY state",
    "page_with_asset": "SELECT p.id, a.sha256, a.provenance, a.synthetic FROM fx_page p JOIN fx_asset a ON a.ws = p.ws AND a.id = p.asset_id",
    "list_items_page": "SELECT id, state FROM fx_item WHERE ws = 'w1' AND id > 'i1' ORDER BY id LIMIT 500",
    "recent_batches": "SELECT id, status FROM fx_batch WHERE ws = 'w2' ORDER BY created_at DESC, id LIMIT 60",
    "release_history": """SELECT channel_id, z.id, rank, coalesce(c.name, 'unknown') AS candidate_name FROM
        (SELECT *, row_number() OVER (PARTITION BY ws, channel_id ORDER BY created_at DESC, id DESC) AS rank FROM fx_release) z LEFT JOIN fx_candidate c ON c.ws = z.ws AND c.id = z.candidate_id WHERE rank <= 50""",
    "latest_dataset_version": "SELECT ws, name, arg_max(id, created_at) AS id, arg_max(semver, created_at) AS semver FROM fx_dataset GROUP BY ws, name",
    "latest_evaluation": "SELECT ws, candidate_id, id FROM (SELECT *, row_number() OVER (PARTITION BY ws, candidate_id ORDER BY created_at DESC, id DESC) AS rn FROM fx_evaluation WHERE status = 'done') z WHERE rn = 1",
    "object_keys_for": "SELECT ws, id, object_key FROM fx_page p WHERE EXISTS (SELECT 1 FROM fx_item i WHERE i.ws = p.ws AND i.page_id = p.id AND i.state = 'queued')",
    "dataset_page_ids": "SELECT DISTINCT ws, page_id FROM fx_truth WHERE dataset = 'synth-clean' AND split = 'test'",
    "list_datasets": "SELECT ws, name, semver, id FROM fx_dataset",
    "list_candidates": "SELECT ws, id, name FROM fx_candidate",
    "visible_class_counts": "SELECT ws, label, count(*) AS n FROM fx_pred_all WHERE score >= 0.5::DOUBLE GROUP BY ws, label",
}.items()}
