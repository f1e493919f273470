"""Benchmark statistics and memory-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import hashing as H
from quirefold.operators import benchstats as B
from quirefold.operators import memory as M
from quirefold.plans.fixtures import oracle, table


def config_matrix(s, d):
    models = table(s, d, "part").select(F.col("p_brand").alias("model"))
    return B.config_matrix(models, ["torch", "onnxruntime"], (1, 2, 4, 8), (4, 8), ("pil_bilinear", "cv2_linear", "cv2_area")).select(
        "model", "runtime", "resize", F.col("batch").cast("bigint").alias("batch"), F.col("threads").cast("bigint").alias("threads"), "config")


def _configs(s, d):
    return table(s, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("config")).distinct()


def trial_order(s, d):
    return B.trial_order(_configs(s, d), 5).select("trial", "config", "slot").withColumn("trial", F.col("trial").cast("bigint"))


def measured_window(s, d):
    return B.measured_window(table(s, d, "fx_sample")).select("config", "trial", "page")


def trial_summary(s, d):
    return B.trial_summary(table(s, d, "fx_sample")).select(
        "config", "trial", "n_pages", F.round("throughput", 6).alias("throughput"), "queue_inclusive_p50", "queue_inclusive_p95", "queue_inclusive_p99",
        "service_p50", "service_p95", "peak_rss", "steady_rss")


def _trials(s, d):
    return B.trial_summary(table(s, d, "fx_sample"))


def config_aggregate(s, d):
    return B.config_aggregate(_trials(s, d))


def stability(s, d):
    return B.stability(_trials(s, d)).select("config", "n_trials", "stable", F.round("cv", 6).alias("cv"), F.round("drift", 6).alias("drift"),
                                             F.array_join("reasons", "; ").alias("reasons"))


def bootstrap_ci(s, d):
    return B.bootstrap_ci(_trials(s, d))


def _envs(s, d):
    e = table(s, d, "fx_env")
    return e.select("n", F.struct(*B.ENV_COLUMNS, F.map_from_arrays(
        F.array(F.lit("torch"), F.lit("onnxruntime")), F.array("torch_version", "onnxruntime_version")).alias("library_versions")).alias("env"))


def comparability(s, d):
    """Each run against the one recorded just before it."""
    e = _envs(s, d)
    before = e.select((F.col("n") + 1).alias("n"), F.col("env").alias("before"))
    return e.join(before, "n").select("n", F.array_join(B.env_differences("before", "env"), ",").alias("differs"))


def speedups(s, d):
    """Trials regrouped so that several configurations pass the stability rule; each ran in a recorded environment of its own."""
    samples = table(s, d, "fx_sample").withColumn("trial", F.col("trial") % 2)
    trials = B.trial_summary(samples)
    e = _envs(s, d)
    # any of the recorded hosts, by the hash of the configuration's name
    mark = F.conv(F.substring(F.sha2(F.col("config").cast("binary"), 256), 1, 6), 16, 10).cast("bigint")
    runs = trials.select("config").distinct().withColumn("n", mark % F.lit(e.count()) + 1).join(e, "n")
    base = e.where(F.col("n") == 1).select(F.lit("r1").alias("run"), F.col("env").alias("base"))
    diffs = runs.withColumn("run", F.lit("r1")).join(base, "run").select("run", "config", F.array_join(B.env_differences("base", "env"), ",").alias("differs"))
    out = B.speedups(B.config_aggregate(trials), B.stability(trials, 0.05, 0.10), B.bootstrap_ci(trials), diffs)
    return out.withColumn("ratio", F.coalesce("ratio", F.lit(-1.0)))


def runnable_verdict(s, d):
    return table(s, d, "fx_env").select("run", B.runnable_verdict().alias("verdict"), B.runnable_verdict(require_ac=False).alias("waived"))


def env_stamp(s, d):
    e = table(s, d, "fx_env")
    stamp = B.env_stamp(F.col("cpu_brand"), F.col("cpu_physical_cores"), F.lit(None), F.col("os_version"), F.col("torch_version"), F.col("onnxruntime_version"),
                        F.lit("2026-10-05T10:00:00.123"), H.host_fingerprint("cpu_brand", "cpu_physical_cores", "mem_total_bytes", "machine", "os_version"))
    return e.select("run", stamp.alias("stamp"))


def host_fingerprint(s, d):
    return table(s, d, "fx_env").select("run", H.host_fingerprint("cpu_brand", "cpu_physical_cores", "mem_total_bytes", "machine", "os_version").alias("host"))


# -- memory ------------------------------------------------------------------------------


def _peaks(s, d):
    return M.marginal_peaks(table(s, d, "fx_memory"), ["host"])


def marginal_peaks(s, d):
    return M.marginal_peaks(table(s, d, "fx_memory"), ["host"], F.lit(1_000_000)).withColumn("batch", F.col("batch").cast("bigint"))


def memory_fits(s, d):
    return M.fit_memory(_peaks(s, d), ["host"])


def fit_memory(s, d):
    return memory_fits(s, d).select("host", "n", "m0", F.round("m_item", 2).alias("m_item"), F.round("max_residual", 2).alias("max_residual"), "valid", "invalid_reason")


def predict_peak(s, d):
    """Predicted peak of every supplier's batch on its host."""
    obs = table(s, d, "fx_memory")
    return obs.join(memory_fits(s, d), "host").select("sample", M.predict_peak(F.col("batch")).alias("predicted"))


def effective_budget(s, d):
    e = table(s, d, "fx_env")
    budget = (F.col("n") * 1_000_003 + 5).cast("bigint")
    return e.select("run", M.effective_budget(budget).alias("budget"), M.host_budget(budget, (F.col("free_fraction") * F.col("mem_total_bytes")).cast("bigint")).alias("host_budget"))


def admit(s, d):
    obs = table(s, d, "fx_memory")
    pending = (F.col("sample") % 5) * 10_000_000
    return obs.join(memory_fits(s, d), "host").select(
        "sample", M.admit(F.col("sample") % 6 + 1, F.lit(90_000_000).cast("bigint"), pending).cast("bigint").alias("admitted"))


def mispredictions(s, d):
    return M.mispredictions(table(s, d, "fx_memory"), memory_fits(s, d), ["host"]).groupBy("host").agg(
        F.sum(F.col("mispredicted").cast("bigint")).alias("mispredictions"), F.count("*").alias("n"))


def pending_bytes(s, d):
    p = table(s, d, "fx_page").withColumn("nbytes", F.col("width_px").cast("bigint") * F.col("height_px") * 3)
    return M.pending_bytes(p, ["ws", "asset_id"], "page_index", "nbytes")


def admission_stats(s, d):
    fits = memory_fits(s, d)
    return M.admission_stats(fits, M.mispredictions(table(s, d, "fx_memory"), fits, ["host"]), ["host"])


QUERIES = {f.__name__: f for f in (
    config_matrix, trial_order, measured_window, trial_summary, config_aggregate, stability, bootstrap_ci, comparability, speedups, runnable_verdict, env_stamp,
    host_fingerprint, marginal_peaks, fit_memory, predict_peak, effective_budget, admit, mispredictions, pending_bytes, admission_stats)}


def _trial_sql(src: str = "fx_sample") -> str:
    return f"""tr AS (SELECT config, trial, count(*) AS n_pages, count(*) * 1000.0::DOUBLE / sum(service_ms) AS throughput,
      quantile_disc(queue_inclusive_ms, 0.5) AS queue_inclusive_p50, quantile_disc(queue_inclusive_ms, 0.95) AS queue_inclusive_p95, quantile_disc(queue_inclusive_ms, 0.99) AS queue_inclusive_p99,
      quantile_disc(service_ms, 0.5) AS service_p50, quantile_disc(service_ms, 0.95) AS service_p95, max(peak_rss) AS peak_rss, arg_max(peak_rss, page) AS steady_rss FROM {src} GROUP BY config, trial)"""


_AGG = """ag AS (SELECT config, count(*) AS n_trials, round(median(throughput), 3) AS throughput_median, round(min(throughput), 3) AS throughput_min, round(max(throughput), 3) AS throughput_max,
    round(median(queue_inclusive_p95), 2) AS p95_median, round(min(queue_inclusive_p95), 2) AS p95_min, round(max(queue_inclusive_p95), 2) AS p95_max,
    round(median(service_p50), 2) AS service_p50, max(peak_rss) AS peak_rss, max(steady_rss) AS steady_rss FROM tr GROUP BY config)"""
_STAB = """st0 AS (SELECT config, count(*) AS n_trials, stddev_samp(throughput) / avg(throughput) AS cv, arg_max(throughput, trial) / arg_min(throughput, trial) - 1 AS drift FROM tr GROUP BY config),
  st AS (SELECT *, cv <= 0.05::DOUBLE AND abs(drift) <= 0.10::DOUBLE AS stable, concat_ws('; ', CASE WHEN cv > 0.05::DOUBLE THEN 'coefficient of variation' END, CASE WHEN abs(drift) > 0.10::DOUBLE THEN 'first-to-last drift' END) AS reasons FROM st0)"""
_BOOT = """bv AS (SELECT config, list(queue_inclusive_p95 ORDER BY trial) AS v, count(*) AS n FROM tr GROUP BY config),
  bd AS (SELECT config, b, n, v[1 + (('0x' || substring(md5(concat_ws(':', '20261005', config, b, i)), 1, 8))::BIGINT % n)] AS x FROM (SELECT config, v, n, unnest(range(0, 10000)) AS b FROM bv) q, LATERAL (SELECT unnest(range(1, n + 1)) AS i) r),
  bs AS (SELECT config, b, quantile_disc(x, 0.95) AS s FROM bd GROUP BY config, b),
  bl AS (SELECT config, list(s ORDER BY s) AS l FROM bs GROUP BY config),
  ci AS (SELECT config, l[251] AS ci_low, l[9751] AS ci_high FROM bl)"""
FIT_SQL = """pk AS (SELECT host, batch, greatest(0, max(peak)) AS peak FROM fx_memory GROUP BY host, batch),
  mn AS (SELECT host, count(*) AS n, avg(batch::DOUBLE) AS mx, avg(peak::DOUBLE) AS my, max(peak) AS top FROM pk GROUP BY host),
  sl AS (SELECT host, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(top) AS top, sum((batch - mx) * (peak - my)) AS xy, sum((batch - mx) * (batch - mx)) AS xx FROM pk JOIN mn USING (host) GROUP BY host),
  f0 AS (SELECT host, n, CASE WHEN n = 1 THEN (top - floor(top * 0.9::DOUBLE))::DOUBLE WHEN xx = 0 THEN 0 ELSE xy / xx END AS m_item, mx, my, top FROM sl),
  f1 AS (SELECT *, CASE WHEN n = 1 THEN floor(top * 0.9::DOUBLE) ELSE my - m_item * mx END AS b0 FROM f0),
  fit AS (SELECT host, any_value(n) AS n, trunc(any_value(b0))::BIGINT AS m0, any_value(m_item) AS m_item, CASE WHEN any_value(n) = 1 THEN abs(any_value(m_item)) ELSE max(abs(peak - (b0 + m_item * batch))) END AS max_residual,
    any_value(b0) >= 0 AS valid, CASE WHEN any_value(b0) < 0 THEN 'negative intercept' ELSE '' END AS invalid_reason, coalesce(max(peak) FILTER (peak > 0), 0)::BIGINT AS largest FROM pk JOIN f1 USING (host) GROUP BY host)"""
PREDICTED_SQL = "(CASE WHEN valid THEN trunc(m0::DOUBLE + {0}::DOUBLE * m_item)::BIGINT ELSE largest END)"
_FP = "substring(sha256(concat_ws('|', coalesce(cpu_brand, ''), cpu_physical_cores, mem_total_bytes, coalesce(machine, ''), coalesce(os_version, ''))), 1, 16)"
# names of the fields in which run b differs from run a
_DIFFERS = """concat_ws(',', CASE WHEN a.cpu_brand IS DISTINCT FROM b.cpu_brand THEN 'cpu_brand' END, CASE WHEN a.cpu_physical_cores IS DISTINCT FROM b.cpu_physical_cores THEN 'cpu_physical_cores' END,
        CASE WHEN a.cpu_perf_levels IS DISTINCT FROM b.cpu_perf_levels THEN 'cpu_perf_levels' END, CASE WHEN a.mem_total_bytes IS DISTINCT FROM b.mem_total_bytes THEN 'mem_total_bytes' END,
        CASE WHEN a.os_version IS DISTINCT FROM b.os_version THEN 'os_version' END, CASE WHEN a.machine IS DISTINCT FROM b.machine THEN 'machine' END,
        CASE WHEN a.onnxruntime_version IS DISTINCT FROM b.onnxruntime_version THEN 'library:onnxruntime' END, CASE WHEN a.torch_version IS DISTINCT FROM b.torch_version THEN 'library:torch' END)"""
_Q = {
    "config_matrix": """SELECT model, runtime, resize, batch, threads, concat_ws('/', model, runtime, resize, concat('b', batch), concat('t', threads)) AS config FROM (SELECT DISTINCT p_brand AS model FROM part) m,
        (VALUES ('torch'), ('onnxruntime')) r(runtime), (VALUES ('pil_bilinear'), ('cv2_linear'), ('cv2_area')) z(resize), (VALUES (1::BIGINT), (2), (4), (8)) b(batch), (VALUES (4::BIGINT), (8)) t(threads)""",
    "trial_order": """WITH c AS (SELECT DISTINCT concat_ws('/', p_brand, p_type) AS config FROM part)
        SELECT trial, config, row_number() OVER (PARTITION BY trial ORDER BY sha256(concat(20261005 + trial, ':', config)), config) AS slot FROM c, range(0, 5) t(trial)""",
    "measured_window": "SELECT config, trial, page FROM (SELECT *, row_number() OVER (PARTITION BY config, trial ORDER BY page) AS rn FROM fx_sample) z WHERE rn > 20 AND rn <= 220",
    "trial_summary": f"WITH {_trial_sql()} SELECT * REPLACE (round(throughput, 6) AS throughput) FROM tr",
    "config_aggregate": f"WITH {_trial_sql()}, {_AGG} SELECT * FROM ag",
    "stability": f"WITH {_trial_sql()}, {_STAB} SELECT config, n_trials, stable, round(cv, 6) AS cv, round(drift, 6) AS drift, reasons FROM st",
    "bootstrap_ci": f"WITH {_trial_sql()}, {_BOOT} SELECT * FROM ci",
    "comparability": f"SELECT b.n, {_DIFFERS} AS differs FROM fx_env a JOIN fx_env b ON b.n = a.n + 1",
    "speedups": f"""WITH s2 AS (SELECT * REPLACE (trial % 2 AS trial) FROM fx_sample), {_trial_sql('s2')}, {_AGG}, {_STAB}, {_BOOT},
        full_ AS (SELECT ag.config, throughput_median, stable, ci_low, ci_high, {_DIFFERS} AS differs FROM ag JOIN st USING (config) JOIN ci USING (config)
          JOIN fx_env b ON b.n = ('0x' || substring(sha256(ag.config), 1, 6))::BIGINT % (SELECT count(*) FROM fx_env) + 1 JOIN fx_env a ON a.n = 1),
        best AS (SELECT * FROM full_ WHERE stable ORDER BY throughput_median DESC, config DESC LIMIT 1),
        o AS (SELECT best.config AS best, f.config AS other, CASE WHEN NOT f.stable THEN 'unstable' WHEN f.differs <> '' THEN concat('differs in ', f.differs) WHEN f.throughput_median = 0 THEN 'zero throughput' ELSE '' END AS reason,
          best.throughput_median / f.throughput_median AS r, best.ci_low AS best_ci_low, best.ci_high AS best_ci_high, f.ci_low AS other_ci_low, f.ci_high AS other_ci_high FROM full_ f, best WHERE f.config <> best.config)
        SELECT best, other, reason, CASE WHEN reason = '' THEN round(r, 2) ELSE -1 END::DOUBLE AS ratio, best_ci_low, best_ci_high, other_ci_low, other_ci_high FROM o""",
    "runnable_verdict": """SELECT run, CASE WHEN power_source = 'battery' THEN 'on_battery' WHEN low_power_mode THEN 'low_power_mode' WHEN free_fraction < 0.25::DOUBLE THEN 'memory_pressure' ELSE 'ok' END AS verdict,
        CASE WHEN free_fraction < 0.25::DOUBLE THEN 'memory_pressure' ELSE 'ok' END AS waived FROM fx_env""",
    "env_stamp": f"SELECT run, concat(cpu_brand, ' ', cpu_physical_cores, 'P+?E, ', os_version, ', torch ', torch_version, ', ORT ', coalesce(onnxruntime_version, '?'), ', measured 2026-10-05T10:00:00, host ', {_FP}) AS stamp FROM fx_env",
    "host_fingerprint": f"SELECT run, {_FP} AS host FROM fx_env",
    "marginal_peaks": "SELECT host, batch::BIGINT AS batch, greatest(0, max(peak - 1000000)) AS peak, max(peak) AS high_water FROM fx_memory GROUP BY host, batch",
    "fit_memory": f"WITH {FIT_SQL} SELECT host, n, m0, round(m_item, 2) AS m_item, round(max_residual, 2) AS max_residual, valid, invalid_reason FROM fit",
    "predict_peak": f"WITH {FIT_SQL} SELECT sample, {PREDICTED_SQL.format('batch')} AS predicted FROM fx_memory JOIN fit USING (host)",
    "effective_budget": """SELECT run, trunc(least(b, greatest(0, b * (1.0::DOUBLE - 0.15::DOUBLE))))::BIGINT AS budget, trunc(greatest(0, least(b, trunc(trunc(free_fraction * mem_total_bytes) * 0.5::DOUBLE)) * (1.0::DOUBLE - 0.15::DOUBLE)))::BIGINT AS host_budget
        FROM (SELECT *, n * 1000003 + 5 AS b FROM fx_env) z""",
    "admit": f"""WITH {FIT_SQL}, o AS (SELECT sample, 90000000 - (sample % 5) * 10000000 AS room, least(sample % 6 + 1, 4) AS most, fit.* FROM fx_memory JOIN fit USING (host))
        SELECT sample, CASE WHEN any_value(room) <= 0 THEN 0 ELSE coalesce(max(b) FILTER (b <= most AND {PREDICTED_SQL.format('b')} + CASE WHEN valid THEN max_residual ELSE 0 END <= room), 0) END AS admitted FROM o, range(1, 5) t(b) GROUP BY sample""",
    "mispredictions": f"WITH {FIT_SQL} SELECT host, count(*) FILTER ({PREDICTED_SQL.format('batch')} > 0 AND peak > {PREDICTED_SQL.format('batch')} * 1.10::DOUBLE) AS mispredictions, count(*) AS n FROM fx_memory JOIN fit USING (host) GROUP BY host",
    "pending_bytes": "SELECT ws, asset_id, sum(width_px::BIGINT * height_px * 3) FILTER (page_index > 0)::BIGINT AS pending_bytes, count(*) AS n FROM fx_page GROUP BY ws, asset_id",
    "admission_stats": f"""WITH {FIT_SQL}, m AS (SELECT host, count(*) FILTER ({PREDICTED_SQL.format('batch')} > 0 AND peak > {PREDICTED_SQL.format('batch')} * 1.10::DOUBLE) AS mispredictions, count(*) AS n_observations FROM fx_memory JOIN fit USING (host) GROUP BY host)
        SELECT host, 4294967296::BIGINT AS budget_bytes, 3650722201::BIGINT AS effective_budget_bytes, valid AS calibration_valid, invalid_reason AS calibration_note, m0, round(m_item, 1) AS m_item, mispredictions, n_observations FROM fit JOIN m USING (host)""",
}
ORACLES = {k: oracle(v) for k, v in _Q.items()}
