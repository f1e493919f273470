"""Memory model: fit, prediction, admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold import constants as K


def marginal_peaks(samples: DataFrame, keys: Sequence[str], baseline: Column | None = None) -> DataFrame:
    """Largest peak above the warm baseline per batch size, and the high-water mark."""
    base = F.lit(0) if baseline is None else baseline
    return samples.groupBy(*keys, "batch").agg(
        F.greatest(F.lit(0), F.max(F.col("peak") - base)).alias("peak"), F.max("peak").alias("high_water"))


def fit_memory(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least squares ``peak = m0 + batch * m_item`` per key, one row per batch size in.

    One sample splits 0.9 / 0.1. A negative intercept makes the fit invalid. The
    deviations are centred before summing so the two engines agree to the last digits.
    """
    x, y = F.col("batch").cast("double"), F.col("peak").cast("double")
    means = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.max("peak").alias("_top"))
    centred = samples.join(means, list(keys))
    slopes = centred.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("_mx").alias("_mx"), F.max("_my").alias("_my"), F.max("_top").alias("_top"),
        F.sum((x - F.col("_mx")) * (y - F.col("_my"))).alias("_xy"), F.sum((x - F.col("_mx")) * (x - F.col("_mx"))).alias("_xx"))
    one = F.col("n") == 1
    single = F.floor(F.col("_top") * 0.9).cast("bigint")
    slope = F.when(one, (F.col("_top") - single).cast("double")).when(F.col("_xx") == 0, 0.0).otherwise(F.col("_xy") / F.col("_xx"))
    fitted = slopes.withColumn("m_item", slope).withColumn(
        "intercept", F.when(one, single.cast("double")).otherwise(F.col("_my") - F.col("m_item") * F.col("_mx")))
    residual = F.abs(y - (F.col("intercept") + F.col("m_item") * x))
    return (
        samples.join(fitted.select(*keys, "n", "m_item", "intercept"), list(keys))
        .groupBy(*keys, "n", "m_item", "intercept")
        .agg(F.max(residual).alias("_res"), F.max(F.when(F.col("peak") > 0, F.col("peak"))).alias("_known"))
        .select(*keys, "n", F.col("intercept").cast("bigint").alias("m0"), "m_item",
                F.when(F.col("n") == 1, F.abs("m_item")).otherwise(F.col("_res")).alias("max_residual"),
                (F.col("intercept") >= 0).alias("valid"),
                F.when(F.col("intercept") < 0, "negative intercept").otherwise("").alias("invalid_reason"),
                F.coalesce("_known", F.lit(0)).cast("bigint").alias("largest_peak")))


def predict_peak(batch: Column) -> Column:
    """Predicted peak of a batch over the columns of ``fit_memory``."""
    line = (F.col("m0").cast("double") + batch.cast("double") * F.col("m_item")).cast("bigint")
    return F.when(F.col("valid"), line).otherwise(F.col("largest_peak"))


def effective_budget(budget: Column, margin: float = K.SAFETY_MARGIN) -> Column:
    """The budget less its safety margin."""
    return F.least(budget.cast("double"), F.greatest(F.lit(0.0), budget * (1.0 - F.lit(margin)))).cast("bigint")


def host_budget(budget: Column, free: Column, share: float = K.HOST_MEM_FRACTION, margin: float = K.SAFETY_MARGIN) -> Column:
    """As above, also held to a share of the memory the host has free."""
    usable = F.least(budget.cast("bigint"), (free * F.lit(share)).cast("bigint"))
    return F.greatest(F.lit(0.0), usable * (1.0 - F.lit(margin))).cast("bigint")


def admit(requested: Column, budget: Column, pending: Column, max_batch: int = K.MAX_BATCH, calibrated: Column | None = None) -> Column:
    """Largest batch whose predicted peak, widened by the fit's residual, fits; 0 refuses."""
    most = F.least(requested, F.lit(max_batch)).cast("int")
    room = budget - pending
    slack = F.when(F.col("valid"), F.col("max_residual")).otherwise(0.0)
    sizes = F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda b: predict_peak(b).cast("double") + slack <= room.cast("double"))
    chosen = F.when(room <= 0, 0).otherwise(F.coalesce(F.array_max(fits), F.lit(0)))
    return chosen if calibrated is None else F.when(calibrated, chosen).otherwise(most)


def mispredictions(observed: DataFrame, fits: DataFrame, keys: Sequence[str], factor: float = K.MISPREDICTION_FACTOR) -> DataFrame:
    """Observations whose peak exceeds the prediction by more than ``factor``."""
    joined = observed.join(fits, list(keys)).withColumn("predicted", predict_peak(F.col("batch")))
    return joined.withColumn("mispredicted", (F.col("predicted") > 0) & (F.col("peak") > F.col("predicted") * factor))


def pending_bytes(pages: DataFrame, keys: Sequence[str], order: str, size: str) -> DataFrame:
    """Decoded bytes held behind the lead page of each group."""
    return pages.groupBy(*keys).agg((F.sum(size) - F.min_by(size, order)).alias("pending_bytes"), F.count("*").alias("n"))


def admission_stats(fits: DataFrame, missed: DataFrame, keys: Sequence[str], budget: int = K.WORKER_MEM_BUDGET) -> DataFrame:
    counts = missed.groupBy(*keys).agg(F.sum(F.col("mispredicted").cast("bigint")).alias("mispredictions"), F.count("*").alias("n_observations"))
    return fits.join(counts, list(keys), "left").select(
        *keys, F.lit(budget).cast("bigint").alias("budget_bytes"), effective_budget(F.lit(budget).cast("bigint")).alias("effective_budget_bytes"),
        F.col("valid").alias("calibration_valid"), F.col("invalid_reason").alias("calibration_note"), "m0", F.round("m_item", 1).alias("m_item"),
        F.coalesce("mispredictions", F.lit(0)).cast("bigint").alias("mispredictions"), F.coalesce("n_observations", F.lit(0)).cast("bigint").alias("n_observations"))
