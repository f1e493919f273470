"""Release gates, the append-only release log, and candidate bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold.functions.jsoncols import decode
from quirefold.operators.catalog import latest_evaluation, newest_per
from quirefold.operators.memory import predict_peak

# Gate names in report order.
GATES = ["G1_quality_clean", "G2_quality_shift", "G3_critical_classes", "G4_runtime_parity", "G5_memory_fit", "G6_provenance"]


def _drop_detail(cand: Column, ref: Column) -> Column:
    return F.format_string("%.5f:%.5f", cand, ref)


def drops_text(drops: Column) -> Column:
    """``label=drop`` of every critical class, by label."""
    return F.array_join(F.transform(F.map_entries(drops), lambda e: F.concat_ws("=", e["key"], F.format_string("%.5f", e["value"]))), ";")


def class_drops(class_ap: DataFrame, keys: list[str]) -> DataFrame:
    """Per candidate: the worst drop over critical classes, and whether all of them pass.

    A class the reference lacks is skipped; one only the candidate lacks loses everything.
    """
    held = class_ap.where(F.col("label").isin(K.CRITICAL_CLASSES) & F.col("ref_ap").isNotNull())
    drop = F.when(F.col("cand_ap").isNull(), F.col("ref_ap")).otherwise(F.col("ref_ap") - F.col("cand_ap"))
    return held.groupBy(*keys).agg(
        F.bool_and(drop <= F.lit(K.GATE_CLASS_DROP)).alias("classes_ok"), F.max(drop).alias("worst_drop"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", F.round(drop, 5).alias("d"))))).alias("drops"))


def gate_verdicts(metrics: DataFrame, drops: DataFrame, keys: list[str], budget: int = K.WORKER_MEM_BUDGET) -> DataFrame:
    """Six rows per candidate: gate, passed, observed, threshold, detail.

    ``drops`` comes from ``class_drops``, ``peak_bytes`` from ``with_predicted_peak``.
    Comparisons stay in DOUBLE. A gate whose input is NULL passes and says so.
    """
    m = metrics.join(drops, keys, "left")
    c = F.col
    missing = c("agreement").isNull()
    unmeasured = c("peak_bytes").isNull()
    no = F.lit(None).cast("double")

    def row(gate: str, passed: Column, observed: Column, threshold: Column, detail: Column) -> Column:
        return F.struct(F.lit(gate).alias("gate"), passed.alias("passed"), observed.cast("double").alias("observed"),
                        threshold.cast("double").alias("threshold"), detail.alias("detail"))

    rows = F.array(
        row(GATES[0], c("ref_map") - c("cand_map") <= F.lit(K.GATE_CLEAN_DROP), F.round("cand_map", 5), c("ref_map"), _drop_detail(c("cand_map"), c("ref_map"))),
        row(GATES[1], c("ref_shift") - c("cand_shift") <= F.lit(K.GATE_SHIFT_DROP), F.round("cand_shift", 5), c("ref_shift"), _drop_detail(c("cand_shift"), c("ref_shift"))),
        row(GATES[2], F.coalesce("classes_ok", F.lit(True)), F.round("worst_drop", 5), F.lit(K.GATE_CLASS_DROP),
            F.coalesce(drops_text(c("drops")), F.lit(""))),
        row(GATES[3], missing | (c("agreement") >= F.lit(K.GATE_AGREEMENT)), F.round("agreement", 5), F.when(~missing, K.GATE_AGREEMENT),
            F.when(missing, "not_applicable").otherwise("agreement")),
        row(GATES[4], unmeasured | (c("peak_bytes") <= budget), c("peak_bytes"), F.when(~unmeasured, budget),
            F.when(unmeasured, "not_calibrated").otherwise("predicted_peak")),
        row(GATES[5], c("provenance_ok"), no, no, F.when(c("provenance_ok"), "ok").otherwise("failed")),
    )
    return m.select(*keys, F.explode(rows).alias("_g")).select(*keys, F.col("_g.gate"), F.coalesce("_g.passed", F.lit(False)).alias("passed"),
                                                               "_g.observed", "_g.threshold", "_g.detail")


def with_predicted_peak(metrics: DataFrame, fits: DataFrame, fit_key: str, batch: Column) -> DataFrame:
    """``metrics`` with the peak that the memory fit of its candidate predicts; NULL where nothing was measured."""
    parts = [fit_key, "m0", "m_item", "valid", "largest_peak"]
    return metrics.drop("peak_bytes").join(fits.select(*parts), fit_key, "left").withColumn(
        "peak_bytes", F.when(F.col("m0").isNotNull(), predict_peak(batch))).drop(*parts[1:])


def gate_summary(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    failed = F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate"))))
    return verdicts.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), failed.alias("_f")).select(
        *keys, "passed", F.when(F.col("passed"), "passed").otherwise(F.concat(F.lit("failed:"), F.array_join("_f", ","))).alias("summary"))


def negative_control_blocked(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    failed = lambda g: F.coalesce(F.bool_or((F.col("gate") == g) & ~F.col("passed")), F.lit(False))
    return verdicts.groupBy(*keys).agg((failed(GATES[0]) & failed(GATES[1])).alias("blocked"))


def provenance(candidates: DataFrame, artifacts: DataFrame, datasets: DataFrame, evaluation_sets: Sequence[str]) -> DataFrame:
    """First failing provenance rule per candidate. ``artifacts`` carries ``verdict`` from the byte check."""
    named = datasets.where(F.col("name").isin(list(evaluation_sets))).groupBy("ws").agg(F.count("*").alias("_n"))
    art = artifacts.select("ws", F.col("id").alias("artifact_id"), "verdict", "revision")
    joined = candidates.join(art, ["ws", "artifact_id"], "left").join(named, "ws", "left")
    why = (
        F.when(F.coalesce("_n", F.lit(0)) == 0, "no_evaluation_set")
        .when(F.coalesce("verdict", F.lit("missing")) != "ok", F.concat(F.lit("artifact_"), F.coalesce("verdict", F.lit("missing"))))
        .when(F.coalesce("revision", F.lit("")).isin("", "main"), "unpinned_revision").otherwise("ok"))
    return joined.select("ws", "id", why.alias("detail")).withColumn("provenance_ok", F.col("detail") == "ok")


def promotable(candidates: DataFrame, evaluations: DataFrame) -> DataFrame:
    """ok, or why a candidate may not be promoted; the first failing rule counts."""
    gates = decode("gates", "array<struct<gate:string,passed:boolean>>")
    newest = latest_evaluation(evaluations).select(
        "ws", F.col("candidate_id").alias("id"), F.lit(True).alias("_done"),
        F.filter(gates, lambda g: ~F.coalesce(g["passed"], F.lit(False))).alias("_failed"))
    code = (
        F.when(~F.col("valid"), "candidate_invalid").when(F.col("_done").isNull(), "gates_not_evaluated")
        .when(F.size("_failed") > 0, "gate_failed").otherwise("ok"))
    return candidates.join(newest, ["ws", "id"], "left").select(
        "ws", "id", code.alias("code"), F.when(code == "gate_failed", F.array_join(F.transform("_failed", lambda g: g["gate"]), ",")).otherwise("").alias("failed"))


# -- release log ------------------------------------------------------------------------


def active_release(channels: DataFrame, releases: DataFrame) -> DataFrame:
    """The release a channel names as live, which need not be the newest row."""
    rel = releases.select("ws", F.col("id").alias("active_release_id"), "candidate_id", "action", "channel_version")
    return channels.join(rel, ["ws", "active_release_id"])


def channel_view(channels: DataFrame, releases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Channel, the live candidate's name and the size of its visible history (at most 50)."""
    names = candidates.select("ws", F.col("id").alias("candidate_id"), F.col("name").alias("active_candidate_name"))
    live = active_release(channels, releases).join(names, ["ws", "candidate_id"], "left").select("ws", "id", "active_candidate_name")
    depth = releases.groupBy("ws", F.col("channel_id").alias("id")).agg(F.least(F.count("*"), F.lit(50)).alias("history"), F.max("created_at").alias("last_change"))
    return channels.join(live, ["ws", "id"], "left").join(depth, ["ws", "id"], "left")


def channel_replay(releases: DataFrame) -> DataFrame:
    """Version and live release of every channel, rebuilt from the log alone.

    The seed and the first promote both carry version 1, so the seed sorts first.
    """
    order = F.struct("channel_version", F.col("action") != "seed", "id")
    return releases.groupBy("ws", "channel_id").agg(
        F.max_by("id", order).alias("active_release_id"), F.max("channel_version").alias("version"), F.count("*").alias("releases"))


def version_conflicts(releases: DataFrame) -> DataFrame:
    return releases.groupBy("ws", "channel_id", "channel_version", (F.col("action") == "seed").alias("seed")).agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where(F.col("n") > 1)


def rollback_target(channels: DataFrame, releases: DataFrame) -> DataFrame:
    current = releases.select("ws", F.col("id").alias("active_release_id"), F.col("previous_release_id").alias("_prev"), F.lit(True).alias("_cur"))
    back = releases.select("ws", F.col("id").alias("_prev"), F.col("candidate_id").alias("target_candidate"), F.lit(True).alias("_found"))
    why = (
        F.when(F.col("active_release_id").isNull(), "no_live_release")
        .when(F.col("_cur").isNull() | F.col("_prev").isNull(), "no_previous")
        .when(F.col("_found").isNull(), "previous_missing").otherwise("ok"))
    return channels.join(current, ["ws", "active_release_id"], "left").join(back, ["ws", "_prev"], "left").select(
        "ws", "id", F.col("_prev").alias("target_release"), "target_candidate", why.alias("reason"))


def pinning_audit(batches: DataFrame, releases: DataFrame, items: DataFrame) -> DataFrame:
    """Items that ran something other than what their batch was pinned to."""
    rel = releases.select("ws", F.col("id").alias("release_id"), F.col("candidate_id").alias("_pinned"))
    pins = batches.select("ws", F.col("id").alias("batch_id"), "release_id", "shadow_candidate_id").join(rel, ["ws", "release_id"])
    expected = F.when(F.col("role") == "shadow", F.col("shadow_candidate_id")).otherwise(F.col("_pinned"))
    return items.join(pins, ["ws", "batch_id"]).withColumn("expected", expected).where(~F.col("expected").eqNullSafe(F.col("candidate_id")))


# -- candidates -----------------------------------------------------------------------------


def candidate_catalogue(candidates: DataFrame, artifacts: DataFrame, preprocess: DataFrame, runtime: DataFrame) -> DataFrame:
    art = artifacts.select("ws", F.col("id").alias("artifact_id"), F.col("name").alias("artifact_name"), F.col("format").alias("artifact_format"), "repo_id", "revision")
    pre = preprocess.select("ws", F.col("id").alias("preprocess_id"), decode("body", "struct<resize:string,target:int>").alias("_p"))
    run = runtime.select("ws", F.col("id").alias("runtime_id"), decode("body", "struct<runtime:string,intra_op_threads:int>").alias("_r"))
    out = candidates.join(art, ["ws", "artifact_id"], "left").join(pre, ["ws", "preprocess_id"], "left").join(run, ["ws", "runtime_id"], "left")
    either = lambda c, d: F.coalesce(c, F.lit(d))
    return out.select(
        "ws", "id", "name", either(F.col("artifact_name"), "unknown").alias("artifact_name"), either(F.col("artifact_format"), "unknown").alias("artifact_format"),
        either(F.col("repo_id"), "").alias("repo_id"), either(F.col("revision"), "").alias("revision"), either(F.col("_r.runtime"), "unknown").alias("runtime"),
        either(F.col("_p.resize"), "unknown").alias("resize"), either(F.col("_p.target"), 640).alias("target"), either(F.col("_r.intra_op_threads"), 0).alias("threads"),
        "score_threshold", "tile_enabled", "valid", either(F.col("invalid_reason"), "").alias("invalid_reason"))


def candidate_request_check(requests: DataFrame, artifacts: DataFrame, preprocess: DataFrame, runtime: DataFrame, candidates: DataFrame) -> DataFrame:
    """Refuse unknown parts; reuse a candidate with the same hash; otherwise create."""

    def known(df: DataFrame, column: str, name: str, flag: str) -> DataFrame:
        return df.select("ws", F.col(column).alias(name), F.lit(True).alias(flag)).distinct()

    owners = newest_per(candidates, ["ws", "candidate_hash"]).select("ws", "candidate_hash", F.col("id").alias("existing_id"))
    out = (
        requests.join(known(artifacts, "sha256", "artifact_sha256", "_a"), ["ws", "artifact_sha256"], "left")
        .join(known(preprocess, "profile_hash", "preprocess_hash", "_p"), ["ws", "preprocess_hash"], "left")
        .join(known(runtime, "profile_hash", "runtime_hash", "_r"), ["ws", "runtime_hash"], "left")
        .join(owners, ["ws", "candidate_hash"], "left"))
    verdict = (
        F.when(F.col("_a").isNull(), "unknown_artifact").when(F.col("_p").isNull(), "unknown_preprocess")
        .when(F.col("_r").isNull(), "unknown_runtime").when(F.col("existing_id").isNotNull(), "reuse").otherwise("create"))
    return out.withColumn("verdict", verdict)


def reference_candidate(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """The pinned reference by its registry hash, never the active release."""
    pinned = registry.where(F.col("role") == "reference").select("candidate_hash").distinct()
    return newest_per(candidates.join(pinned, "candidate_hash", "left_semi"), ["ws"])
