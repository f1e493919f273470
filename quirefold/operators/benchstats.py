"""Benchmark statistics: trial summaries, stability, bootstrap intervals, comparability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold.operators.ordering import HOT_ROWS, nearest_rank, position, ranked_columns, ranked_values

ENV_COLUMNS = K.ENV_FIELDS


def config_matrix(
    models: DataFrame, runtimes: Sequence[str], batches: Sequence[int] = (1, 4), threads: Sequence[int] = (4,),
    resizes: Sequence[str] = ("pil_bilinear",), tile: bool = False,
) -> DataFrame:
    """Every combination of knobs for each distinct model, with its key."""
    out = models.select("model").distinct()
    for name, values in (("runtime", runtimes), ("resize", resizes), ("batch", batches), ("threads", threads)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    parts = ["model", "runtime", "resize", F.concat(F.lit("b"), "batch"), F.concat(F.lit("t"), "threads")]
    return out.withColumn("config", F.concat_ws("/", *parts, *([F.lit("tile")] if tile else [])))


def trial_order(configs: DataFrame, trials: int, seed: int = K.BOOTSTRAP_SEED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A reproducible shuffle of the configurations for each trial."""
    dealt = configs.select("config", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")).withColumn(
        "_key", F.sha2(F.concat((F.col("trial") + seed).cast("string"), F.lit(":"), F.col("config")), 256))
    return position(dealt, ["trial"], [F.col("_key"), F.col("config")], "slot", hot_rows).drop("_key")


def measured_window(samples: DataFrame, order: str = "page", warmup: int = K.WARMUP_PAGES, measured: int = K.MEASURED_PAGES) -> DataFrame:
    """Skip the warm-up pages of each trial and keep the measured ones."""
    walk = Window.partitionBy("config", "trial").orderBy(order)
    return samples.withColumn("_rn", F.row_number().over(walk)).where(F.col("_rn") <= warmup + measured).where(F.col("_rn") > warmup).drop("_rn")


def trial_summary(samples: DataFrame, order: str = "page") -> DataFrame:
    """Throughput over summed service time, nearest-rank percentiles, peak and last RSS."""
    trial = ["config", "trial"]
    ranks = {"p50": nearest_rank(0.50), "p95": nearest_rank(0.95), "p99": nearest_rank(0.99)}
    whole = [
        F.count("*").alias("n_pages"), (F.count("*") * 1000.0 / F.sum("service_ms")).alias("throughput"),
        F.max("peak_rss").alias("peak_rss"), F.max_by("peak_rss", order).alias("steady_rss")]
    out = ranked_columns(samples, trial, {"queue_inclusive": "queue_inclusive_ms", "service": "service_ms"}, ranks, whole)
    return out.drop("queue_inclusive_n", "service_n", "service_p99")


def config_aggregate(trials: DataFrame) -> DataFrame:
    return trials.groupBy("config").agg(
        F.count("*").alias("n_trials"),
        F.round(F.median("throughput"), 3).alias("throughput_median"), F.round(F.min("throughput"), 3).alias("throughput_min"),
        F.round(F.max("throughput"), 3).alias("throughput_max"),
        F.round(F.median("queue_inclusive_p95"), 2).alias("p95_median"), F.round(F.min("queue_inclusive_p95"), 2).alias("p95_min"),
        F.round(F.max("queue_inclusive_p95"), 2).alias("p95_max"),
        F.round(F.median("service_p50"), 2).alias("service_p50"), F.max("peak_rss").alias("peak_rss"), F.max("steady_rss").alias("steady_rss"))


def stability(trials: DataFrame, cv_limit: float = K.CV_TOLERANCE, drift_limit: float = K.DRIFT_TOLERANCE) -> DataFrame:
    """Coefficient of variation and first-to-last drift of throughput, with reasons."""
    base = trials.groupBy("config").agg(
        F.count("*").alias("n_trials"), F.stddev_samp("throughput").alias("_sd"), F.avg("throughput").alias("_mean"),
        F.min_by("throughput", "trial").alias("_first"), F.max_by("throughput", "trial").alias("_last"))
    many = F.col("n_trials") >= 2
    cv = F.when(many, F.when(F.col("_mean") != 0, F.col("_sd") / F.col("_mean")).otherwise(F.lit(float("inf"))))
    drift = F.when(many, F.when(F.col("_first") != 0, (F.col("_last") - F.col("_first")) / F.col("_first")).otherwise(F.lit(float("inf"))))
    reasons = F.array_compact(F.array(
        F.when(~many, "fewer than two trials"), F.when(F.col("cv") > cv_limit, "coefficient of variation"),
        F.when(F.abs("drift") > drift_limit, "first-to-last drift")))
    return base.withColumns({"cv": cv, "drift": drift}).withColumn("reasons", reasons).select(
        "config", "n_trials", (F.size("reasons") == 0).alias("stable"), "cv", "drift", "reasons")


def bootstrap_ci(
    trials: DataFrame, value: str = "queue_inclusive_p95", p: float = 0.95, resamples: int = K.BOOTSTRAP_RESAMPLES, seed: int = K.BOOTSTRAP_SEED,
) -> DataFrame:
    """Percentile interval of the p95 over seeded resamples of each configuration's trials.

    A configuration has a handful of trials, so its values travel as one array and the
    resamples are spread over the cluster; draws come from a hash, not from a generator.
    """
    values = trials.groupBy("config").agg(F.sort_array(F.collect_list(F.struct("trial", F.col(value).alias("v")))).alias("_t")).select(
        "config", F.transform("_t", lambda t: t["v"]).alias("_v"), F.size("_t").alias("_n"))
    parts = int(trials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = values.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_b")).repartition(parts, "config", "_b")

    def draw(i: Column) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), F.col("config"), F.col("_b"), i)
        return F.element_at("_v", (F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.col("_n")) + 1).cast("int"))

    rank = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_n"))).cast("int")
    stats = spread.select("config", "_n", F.element_at(F.sort_array(F.transform(F.sequence(F.lit(1), F.col("_n")), draw)), rank).alias("_s"))
    lo, hi = int((1 - p) / 2 * resamples), min(resamples - 1, int((1 + p) / 2 * resamples))
    return ranked_values(stats, ["config"], "_s", {"ci_low": F.lit(lo), "ci_high": F.lit(hi)}).select("config", "ci_low", "ci_high")


def env_differences(a: str, b: str, fields: Sequence[str] = ENV_COLUMNS, libraries: str = "library_versions") -> Column:
    """Names of environment fields that differ between two structs, then ``library:<name>`` for each version that does."""
    plain = F.array_compact(F.array(*[F.when(~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), f) for f in fields]))
    left = F.coalesce(F.col(f"{a}.{libraries}"), F.create_map().cast("map<string,string>"))
    right = F.coalesce(F.col(f"{b}.{libraries}"), F.create_map().cast("map<string,string>"))
    both = F.map_zip_with(left, right, lambda _, x, y: ~x.eqNullSafe(y))
    moved = F.map_keys(F.map_filter(both, lambda _, differs: differs))
    return F.concat(plain, F.transform(F.sort_array(moved), lambda k: F.concat(F.lit("library:"), k)))


def runnable_verdict(require_ac: bool = True, min_free: float = K.MIN_FREE_FRACTION) -> Column:
    """The first rule an environment breaks, or ok."""
    ac = F.lit(require_ac)
    return (
        F.when(ac & (F.col("power_source") == "battery"), "on_battery").when(ac & F.col("low_power_mode"), "low_power_mode")
        .when(F.col("free_fraction") < min_free, "memory_pressure").otherwise("ok"))


# Fixed value: the layout of the environment line in reports.
def env_stamp(cpu: Column, performance: Column, efficiency: Column, os_version: Column, torch: Column, ort: Column, at: Column, host: Column) -> Column:
    ask = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(
        F.coalesce(cpu, F.lit("unknown CPU")), F.lit(" "), ask(performance), F.lit("P+"), ask(efficiency), F.lit("E, "), ask(os_version),
        F.lit(", torch "), ask(torch), F.lit(", ORT "), ask(ort), F.lit(", measured "), F.substring(ask(at), 1, 19), F.lit(", host "), ask(host))


def speedups(aggregates: DataFrame, stable: DataFrame, ci: DataFrame, env_diffs: DataFrame) -> DataFrame:
    """Per run, the best stable configuration against every other one: a ratio, or the reason there is none.

    ``env_diffs`` carries ``run, config, differs`` (text, empty when the runs are comparable).
    A run compares the points of one configuration matrix, so its window is small.
    """
    full = aggregates.drop("n_trials").join(stable.select("config", "stable"), "config").join(ci, "config").join(env_diffs, "config")
    leader = F.max(F.when(F.col("stable"), F.struct("throughput_median", "config", "ci_low", "ci_high"))).over(Window.partitionBy("run"))
    paired = full.withColumn("best", leader).where(F.col("config") != F.col("best.config"))
    reason = (
        F.when(~F.col("stable"), "unstable").when(F.col("differs") != "", F.concat(F.lit("differs in "), F.col("differs")))
        .when(F.col("throughput_median") == 0, "zero throughput").otherwise(""))
    return paired.withColumn("reason", reason).select(
        F.col("best.config").alias("best"), F.col("config").alias("other"), "reason",
        F.when(F.col("reason") == "", F.round(F.col("best.throughput_median") / F.col("throughput_median"), 2)).alias("ratio"),
        F.col("best.ci_low").alias("best_ci_low"), F.col("best.ci_high").alias("best_ci_high"), F.col("ci_low").alias("other_ci_low"), F.col("ci_high").alias("other_ci_high"))
