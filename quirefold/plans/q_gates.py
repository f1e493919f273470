"""Gate, release and candidate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.operators import gates as G
from quirefold.operators import ingest as I
from quirefold.plans import q_bench
from quirefold.plans.fixtures import oracle, table


def _drops(s, d):
    return G.class_drops(table(s, d, "fx_class_ap"), ["candidate"])


#: Bytes: the fits of the derived samples lie around it.
BUDGET = 40_000_000


def _verdicts(s, d):
    """Peaks come from the memory fits: a candidate runs on the host of its number, in batches of one to eight."""
    metrics = table(s, d, "fx_metrics").withColumn("host", F.concat(F.lit("h"), F.col("p_partkey") % 29))
    peaks = G.with_predicted_peak(metrics, q_bench.memory_fits(s, d), "host", F.col("p_partkey") % 8 + 1)
    return G.gate_verdicts(peaks, _drops(s, d), ["candidate"], budget=BUDGET)


def gate_verdicts(s, d):
    return _verdicts(s, d).select("candidate", "gate", "passed", F.coalesce("observed", F.lit(-1.0)).alias("observed"),
                                  F.round(F.coalesce("threshold", F.lit(-1.0)), 6).alias("threshold"), "detail")


def _one(gate):
    def run(s, d):
        return _verdicts(s, d).where(F.col("gate") == gate).select("candidate", "passed", F.coalesce("observed", F.lit(-1.0)).alias("observed"))

    return run


def gate_critical_classes(s, d):
    return _drops(s, d).select("candidate", "classes_ok", F.round("worst_drop", 5).alias("worst_drop"), G.drops_text(F.col("drops")).alias("drops"))


def gate_summary(s, d):
    return G.gate_summary(_verdicts(s, d), ["candidate"])


def negative_control_blocked(s, d):
    return G.negative_control_blocked(_verdicts(s, d), ["candidate"])


def _artifacts(s, d):
    a = table(s, d, "fx_artifact")
    return I.artifact_verify(a, a.select("ws", "path", "actual_sha").where(F.col("actual_sha").isNotNull()))


def artifact_verify(s, d):
    return _artifacts(s, d).select("ws", "id", "verdict")


def gate_provenance(s, d):
    return G.provenance(table(s, d, "fx_candidate"), _artifacts(s, d), table(s, d, "fx_dataset"), ("src0", "src1"))


def promotable(s, d):
    return G.promotable(table(s, d, "fx_candidate"), table(s, d, "fx_evaluation"))


def active_release(s, d):
    return G.active_release(table(s, d, "fx_channel"), table(s, d, "fx_release")).select("ws", "id", "active_release_id", "candidate_id", "action")


def channel_view(s, d):
    return G.channel_view(table(s, d, "fx_channel"), table(s, d, "fx_release"), table(s, d, "fx_candidate")).select(
        "ws", "id", "version", "active_release_id", F.coalesce("active_candidate_name", F.lit("")).alias("active_candidate_name"), "history", F.unix_millis("last_change").alias("last_ms"))


def channel_replay(s, d):
    return G.channel_replay(table(s, d, "fx_release"))


def version_conflicts(s, d):
    return G.version_conflicts(table(s, d, "fx_release")).select("ws", "channel_id", "channel_version", "n", "first_id", "last_id")


def rollback_target(s, d):
    return G.rollback_target(table(s, d, "fx_channel"), table(s, d, "fx_release"))


def pinning_audit(s, d):
    return G.pinning_audit(table(s, d, "fx_batch"), table(s, d, "fx_release"), table(s, d, "fx_item")).select(
        "ws", "id", "role", "candidate_id", F.coalesce("expected", F.lit("")).alias("expected"))


def candidate_catalogue(s, d):
    return G.candidate_catalogue(table(s, d, "fx_candidate"), table(s, d, "fx_artifact"), table(s, d, "fx_preprocess"), table(s, d, "fx_runtime")).select(
        "id", "artifact_name", "artifact_format", "revision", "runtime", "resize", F.col("target").cast("bigint").alias("target"),
        F.col("threads").cast("bigint").alias("threads"), "valid", "invalid_reason")


def candidate_request_check(s, d):
    """One request per customer, naming parts that may or may not exist in its workspace."""
    c = table(s, d, "customer")
    sha = lambda text: F.sha2(text, 256)
    k = F.col("c_custkey")
    req = c.select(
        k.alias("request"), F.concat(F.lit("w"), k % 4).alias("ws"), sha(F.concat(F.lit("Supplier#"), F.lpad((k % 12).cast("string"), 9, "0"))).alias("artifact_sha256"),
        sha(F.concat(F.lit("pp"), k % 28)).alias("preprocess_hash"), sha(F.concat(F.lit("rp"), k % 26)).alias("runtime_hash"), sha(F.concat(F.lit("cand"), k * 2)).alias("candidate_hash"))
    return G.candidate_request_check(req, table(s, d, "fx_artifact"), table(s, d, "fx_preprocess"), table(s, d, "fx_runtime"), table(s, d, "fx_candidate")).select(
        "request", "verdict", F.coalesce("existing_id", F.lit("")).alias("existing_id"))


def reference_candidate(s, d):
    registry = table(s, d, "part").select(F.sha2(F.concat(F.lit("cand"), "p_partkey"), 256).alias("candidate_hash"),
                                          F.when(F.col("p_size") == 7, "reference").otherwise("candidate").alias("role"))
    return G.reference_candidate(table(s, d, "fx_candidate"), registry).select("ws", "id", "name")


QUERIES = {f.__name__: f for f in (
    gate_verdicts, gate_critical_classes, gate_summary, negative_control_blocked, artifact_verify, gate_provenance, promotable, active_release, channel_view,
    channel_replay, version_conflicts, rollback_target, pinning_audit, candidate_catalogue, candidate_request_check, reference_candidate)}
QUERIES |= {"gate_quality_clean": _one(G.GATES[0]), "gate_quality_shift": _one(G.GATES[1]), "gate_parity": _one(G.GATES[3]), "gate_memory_fit": _one(G.GATES[4])}

_DROPS = """cd AS (SELECT candidate, label, CASE WHEN cand_ap IS NULL THEN ref_ap ELSE ref_ap - cand_ap END AS dr FROM fx_class_ap WHERE label IN ('table', 'picture', 'text', 'title') AND ref_ap IS NOT NULL),
  dr AS (SELECT candidate, bool_and(dr <= 0.030::DOUBLE) AS classes_ok, max(dr) AS worst_drop, string_agg(concat(label, '=', printf('%.5f', round(dr, 5))), ';' ORDER BY label) AS drops FROM cd GROUP BY candidate)"""
_DET = "concat(printf('%.5f', {0}), ':', printf('%.5f', {1}))"
_PEAKS = f"""{q_bench.FIT_SQL}, peaks AS (SELECT m.* EXCLUDE (peak_bytes), CASE WHEN fit.m0 IS NOT NULL THEN {q_bench.PREDICTED_SQL.format('(p_partkey % 8 + 1)')} END AS peak_bytes
    FROM fx_metrics m LEFT JOIN fit ON fit.host = concat('h', p_partkey % 29))"""
_V = f"""{_PEAKS}, {_DROPS}, v AS (
  SELECT candidate, 'G1_quality_clean' AS gate, ref_map - cand_map <= 0.010::DOUBLE AS passed, round(cand_map, 5) AS observed, ref_map AS threshold, {_DET.format('cand_map', 'ref_map')} AS detail FROM fx_metrics
  UNION ALL SELECT candidate, 'G2_quality_shift', ref_shift - cand_shift <= 0.020::DOUBLE, round(cand_shift, 5), ref_shift, {_DET.format('cand_shift', 'ref_shift')} FROM fx_metrics
  UNION ALL SELECT candidate, 'G3_critical_classes', coalesce(classes_ok, true), round(worst_drop, 5), 0.03::DOUBLE, coalesce(drops, '') FROM fx_metrics LEFT JOIN dr USING (candidate)
  UNION ALL SELECT candidate, 'G4_runtime_parity', agreement IS NULL OR agreement >= 0.98::DOUBLE, round(agreement, 5), CASE WHEN agreement IS NOT NULL THEN 0.98::DOUBLE END, CASE WHEN agreement IS NULL THEN 'not_applicable' ELSE 'agreement' END FROM fx_metrics
  UNION ALL SELECT candidate, 'G5_memory_fit', peak_bytes IS NULL OR peak_bytes <= {BUDGET}, peak_bytes::DOUBLE, CASE WHEN peak_bytes IS NOT NULL THEN {BUDGET}::DOUBLE END, CASE WHEN peak_bytes IS NULL THEN 'not_calibrated' ELSE 'predicted_peak' END FROM peaks
  UNION ALL SELECT candidate, 'G6_provenance', provenance_ok, NULL, NULL, CASE WHEN provenance_ok THEN 'ok' ELSE 'failed' END FROM fx_metrics)"""
_ONE = f"WITH {_V} SELECT candidate, passed, coalesce(observed, -1)::DOUBLE AS observed FROM v WHERE gate = "
_ART = "art AS (SELECT *, CASE WHEN actual_sha IS NULL THEN 'missing' WHEN actual_sha <> sha256 THEN 'mismatch' ELSE 'ok' END AS verdict FROM fx_artifact)"
_Q = {
    "gate_verdicts": f"WITH {_V} SELECT candidate, gate, passed, coalesce(observed, -1)::DOUBLE AS observed, round(coalesce(threshold, -1), 6)::DOUBLE AS threshold, detail FROM v",
    "gate_quality_clean": _ONE + "'G1_quality_clean'", "gate_quality_shift": _ONE + "'G2_quality_shift'", "gate_parity": _ONE + "'G4_runtime_parity'", "gate_memory_fit": _ONE + "'G5_memory_fit'",
    "gate_critical_classes": f"WITH {_DROPS} SELECT candidate, classes_ok, round(worst_drop, 5) AS worst_drop, drops FROM dr",
    "gate_summary": f"WITH {_V} SELECT candidate, bool_and(passed) AS passed, CASE WHEN bool_and(passed) THEN 'passed' ELSE concat('failed:', string_agg(gate, ',' ORDER BY gate) FILTER (NOT passed)) END AS summary FROM v GROUP BY candidate",
    "negative_control_blocked": f"WITH {_V} SELECT candidate, count(*) FILTER (NOT passed AND gate IN ('G1_quality_clean', 'G2_quality_shift')) = 2 AS blocked FROM v GROUP BY candidate",
    "artifact_verify": f"WITH {_ART} SELECT ws, id, verdict FROM art",
    "gate_provenance": f"""WITH {_ART}, p AS (SELECT c.ws, c.id, CASE WHEN NOT EXISTS (SELECT 1 FROM fx_dataset d WHERE d.ws = c.ws AND d.name IN ('src0', 'src1')) THEN 'no_evaluation_set'
        WHEN coalesce(a.verdict, 'missing') <> 'ok' THEN concat('artifact_', coalesce(a.verdict, 'missing')) WHEN coalesce(a.revision, '') IN ('', 'main') THEN 'unpinned_revision' ELSE 'ok' END AS detail
        FROM fx_candidate c LEFT JOIN art a ON a.ws = c.ws AND a.id = c.artifact_id) SELECT *, detail = 'ok' AS provenance_ok FROM p""",
    "promotable": """WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ws, candidate_id ORDER BY created_at DESC, id DESC) AS rn FROM fx_evaluation WHERE status = 'done') z WHERE rn = 1),
        f AS (SELECT ws, candidate_id, concat_ws(',', CASE WHEN contains(gates, '"G1_quality_clean","passed":false') THEN 'G1_quality_clean' END, CASE WHEN contains(gates, '"G2_quality_shift","passed":false') THEN 'G2_quality_shift' END) AS failed FROM n)
        SELECT c.ws, c.id, CASE WHEN NOT valid THEN 'candidate_invalid' WHEN f.ws IS NULL THEN 'gates_not_evaluated' WHEN failed <> '' THEN 'gate_failed' ELSE 'ok' END AS code,
          CASE WHEN valid AND f.ws IS NOT NULL THEN failed ELSE '' END AS failed FROM fx_candidate c LEFT JOIN f ON f.ws = c.ws AND f.candidate_id = c.id""",
    "active_release": "SELECT c.ws, c.id, c.active_release_id, r.candidate_id, r.action FROM fx_channel c JOIN fx_release r ON r.ws = c.ws AND r.id = c.active_release_id",
    "channel_view": """SELECT c.ws, c.id, c.version, c.active_release_id, coalesce(k.name, '') AS active_candidate_name, (SELECT least(count(*), 50) FROM fx_release h WHERE h.ws = c.ws AND h.channel_id = c.id) AS history,
        (SELECT @ms(max(created_at)) FROM fx_release h WHERE h.ws = c.ws AND h.channel_id = c.id) AS last_ms
        FROM fx_channel c LEFT JOIN fx_release r ON r.ws = c.ws AND r.id = c.active_release_id LEFT JOIN fx_candidate k ON k.ws = r.ws AND k.id = r.candidate_id""",
    "channel_replay": """SELECT ws, channel_id, id AS active_release_id, version, releases FROM (SELECT *, row_number() OVER (PARTITION BY ws, channel_id ORDER BY channel_version DESC, (action <> 'seed') DESC, id DESC) AS rn,
        max(channel_version) OVER (PARTITION BY ws, channel_id) AS version, count(*) OVER (PARTITION BY ws, channel_id) AS releases FROM fx_release) z WHERE rn = 1""",
    "version_conflicts": "SELECT ws, channel_id, channel_version, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM fx_release GROUP BY ws, channel_id, channel_version, action = 'seed' HAVING count(*) > 1",
    "rollback_target": """SELECT c.ws, c.id, r.previous_release_id AS target_release, p.candidate_id AS target_candidate, CASE WHEN c.active_release_id IS NULL THEN 'no_live_release' WHEN r.previous_release_id IS NULL THEN 'no_previous'
        WHEN p.id IS NULL THEN 'previous_missing' ELSE 'ok' END AS reason FROM fx_channel c LEFT JOIN fx_release r ON r.ws = c.ws AND r.id = c.active_release_id LEFT JOIN fx_release p ON p.ws = r.ws AND p.id = r.previous_release_id""",
    "pinning_audit": """SELECT i.ws, i.id, i.role, i.candidate_id, coalesce(CASE WHEN role = 'shadow' THEN b.shadow_candidate_id ELSE r.candidate_id END, '') AS expected
        FROM fx_item i JOIN fx_batch b ON b.ws = i.ws AND b.id = i.batch_id JOIN fx_release r ON r.ws = b.ws AND r.id = b.release_id WHERE i.candidate_id IS DISTINCT FROM CASE WHEN role = 'shadow' THEN b.shadow_candidate_id ELSE r.candidate_id END""",
    "candidate_catalogue": """SELECT c.id, coalesce(a.name, 'unknown') AS artifact_name, coalesce(a.format, 'unknown') AS artifact_format, coalesce(a.revision, '') AS revision, coalesce(CASE WHEN json_valid(r.body) THEN json_extract_string(r.body, '$.runtime') END, 'unknown') AS runtime,
        coalesce(CASE WHEN json_valid(p.body) THEN json_extract_string(p.body, '$.resize') END, 'unknown') AS resize, coalesce(CASE WHEN json_valid(p.body) THEN CAST(json_extract(p.body, '$.target') AS BIGINT) END, 640) AS target,
        coalesce(CASE WHEN json_valid(r.body) THEN CAST(json_extract(r.body, '$.intra_op_threads') AS BIGINT) END, 0) AS threads, valid, coalesce(invalid_reason, '') AS invalid_reason
        FROM fx_candidate c LEFT JOIN fx_artifact a ON a.ws = c.ws AND a.id = c.artifact_id LEFT JOIN fx_preprocess p ON p.ws = c.ws AND p.id = c.preprocess_id LEFT JOIN fx_runtime r ON r.ws = c.ws AND r.id = c.runtime_id""",
    "candidate_request_check": """WITH q AS (SELECT c_custkey AS request, concat('w', c_custkey % 4) AS ws, sha256(concat('Supplier#', lpad(@text(c_custkey % 12), 9, '0'))) AS a, sha256(concat('pp', c_custkey % 28)) AS p, sha256(concat('rp', c_custkey % 26)) AS r, sha256(concat('cand', c_custkey * 2)) AS h FROM customer)
        SELECT request, CASE WHEN NOT EXISTS (SELECT 1 FROM fx_artifact x WHERE x.ws = q.ws AND x.sha256 = a) THEN 'unknown_artifact' WHEN NOT EXISTS (SELECT 1 FROM fx_preprocess x WHERE x.ws = q.ws AND x.profile_hash = p) THEN 'unknown_preprocess'
          WHEN NOT EXISTS (SELECT 1 FROM fx_runtime x WHERE x.ws = q.ws AND x.profile_hash = r) THEN 'unknown_runtime' WHEN c.id IS NOT NULL THEN 'reuse' ELSE 'create' END AS verdict, coalesce(c.id, '') AS existing_id
        FROM q LEFT JOIN fx_candidate c ON c.ws = q.ws AND c.candidate_hash = h""",
    "reference_candidate": """SELECT ws, id, name FROM (SELECT c.*, row_number() OVER (PARTITION BY ws ORDER BY created_at DESC, id DESC) AS rn FROM fx_candidate c JOIN part p ON c.id = concat('c', p.p_partkey) WHERE p.p_size = 7) z WHERE rn = 1""",
}
ORACLES = {k: oracle(v) for k, v in _Q.items()}
