"""Ordered work over groups of any size.

A window partitioned by a hot key runs in one task. The helpers here measure the
largest group first (a partial aggregate, one row back to the driver) and pick a
plain window when every group is small, or a range-partitioned running total when
one is not. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import materialize

HOT_ROWS = 1_000_000
#: Rows of a group that are sorted in one place, and different values of the last bucket of a larger one.
RANK_ROWS = 100_000
#: Open buckets (some 100 bytes each) up to this number are broadcast.
BROADCAST_RANKS = 100_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    sizes = df.groupBy(*keys).count() if keys else df.groupBy().count()
    return sizes.agg(F.max("count")).first()[0] or 0


def oversize_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys of groups above ``limit`` rows, or None when there is none."""
    big = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    if big.isEmpty():
        return None
    return materialize(big)


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    hot_rows: int = HOT_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running totals of ``sums`` within ``group`` in ``order``.

    ``sized_by`` may name a cheaper frame that bounds the group sizes of ``df``.
    """
    values = df.select("*", *[e.alias(f"_v_{n}") for n, e in sums.items()])
    raw = [f"_v_{n}" for n in sums]
    if largest_group(df if sized_by is None else sized_by, group) <= hot_rows:
        frame = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return values.select(
            *df.columns, *[F.sum(f"_v_{n}").over(frame).alias(n) for n in sums]
        )

    # Range partitioning splits a hot group over many slices in order; each slice is
    # summed on its own and shifted by the totals of the slices before it.
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        values.repartitionByRange(slices, *[F.col(g) for g in group], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    key = [*group, "_slice"]
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*key)
        .agg(*[F.sum(v).alias(f"_t{v}") for v in raw])
        .select(*key, *[F.coalesce(F.sum(f"_t{v}").over(before), F.lit(0)).alias(f"_o{v}") for v in raw])
    )
    local = ranged.select(*df.columns, "_slice", *[F.sum(v).over(inside).alias(f"_l{v}") for v in raw])
    return local.join(offsets, key).select(
        *df.columns, *[(F.col(f"_l_v_{n}") + F.col(f"_o_v_{n}")).alias(n) for n in sums]
    )


def position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str = "pos",
    hot_rows: int = HOT_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """1-based position within ``group``; the order must be total."""
    return running_sums(df, group, order, {name: F.lit(1).cast("bigint")}, hot_rows, sized_by)


def ordered_bits(value: Column) -> Column:
    """The bits of a double as a bigint of the same order; both zeros are 0, NaN comes last."""
    a = F.abs(value)
    guess = F.floor(F.log2(a)).cast("double")
    two = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(a >= two(guess + 1), guess + 1).when(a < two(guess), guess - 1).otherwise(guess)
    top = F.lit(2047 << 52).cast("bigint")
    whole = (
        F.when(F.isnan(a), top + 1).when(a == float("inf"), top).when(a == 0, F.lit(0).cast("bigint"))
        .when(a < 2.0**-1022, (a / 2.0**-1074).cast("bigint"))
        .otherwise((e + 1023).cast("bigint") * (1 << 52) + ((a / two(e) - 1) * 2.0**52).cast("bigint"))
    )
    return F.when(value < 0, -whole).otherwise(whole)


def _radix_ranks(rows: DataFrame, group: Sequence[str], ranks: dict[str, Column], bound: int) -> DataFrame:
    """``group, n`` and each rank of the values ``_v``, for groups of any size and spread.

    The bits of the values are refined sixteen at a time: each round counts the values of
    the one bucket that holds the rank and keeps the part that still does, until that is
    ``bound`` different values at most. Four rounds go down to a single value.
    """
    counts = materialize(rows.groupBy(*group, "_v").agg(F.count("*").alias("_c")).withColumn("_bits", ordered_bits(F.col("_v").cast("double"))))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()])
    open_ = materialize(
        counts.groupBy(*group).agg(F.sum("_c").alias("n"), F.count("*").alias("_rows"))
        .select(*group, "n", "_rows", F.explode(wanted).alias("_w"))
        .select(*group, "n", "_rows", F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_r"), F.lit(0).cast("bigint").alias("_top"))
    )
    digit = lambda shift: F.shiftright("_bits", shift) if shift < 64 else F.lit(0).cast("bigint")
    shift = 64

    def inside() -> DataFrame:
        """Values of the open buckets, once for each rank that is looked for there."""
        few = open_.count() <= BROADCAST_RANKS
        return counts.withColumn("_top", digit(shift)).join(F.broadcast(open_) if few else open_, [*group, "_top"])

    while shift and (open_.agg(F.max("_rows")).first()[0] or 0) > bound:
        held, shift = inside().drop("_top", "_rows"), shift - 16
        parts = held.groupBy(*group, "n", "_name", "_r", digit(shift).alias("_top")).agg(F.sum("_c").alias("_bc"), F.count("*").alias("_rows"))
        walk = Window.partitionBy(*group, "_name").orderBy("_top").rowsBetween(Window.unboundedPreceding, 0)
        found = parts.withColumn("_end", F.sum("_bc").over(walk)).where((F.col("_r") < F.col("_end")) & (F.col("_r") >= F.col("_end") - F.col("_bc")))
        open_ = materialize(found.select(*group, "n", "_rows", "_name", (F.col("_r") - F.col("_end") + F.col("_bc")).alias("_r"), "_top"))
    walk = Window.partitionBy(*group, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = inside().withColumn("_end", F.sum("_c").over(walk)).where((F.col("_r") < F.col("_end")) & (F.col("_r") >= F.col("_end") - F.col("_c")))
    return picked.groupBy(*group).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in ranks])


def ranked_columns(
    df: DataFrame, group: Sequence[str], values: dict[str, str], ranks: dict[str, Column], more: Sequence[Column] = (), limit: int = RANK_ROWS,
) -> DataFrame:
    """Exact order statistics of several columns per group, with further aggregates ``more`` beside them.

    ``values`` maps a metric to its column, ``ranks`` a name to a 0-based rank written over
    the column ``n`` (how many values the metric has in the group, nulls apart). The result
    has ``<metric>_n`` and ``<metric>_<name>``. Groups of up to ``limit`` rows are sorted
    where one shuffle brings them together; larger ones are narrowed down by their bits.
    """
    hot = oversize_groups(df, group, limit)
    calm = df if hot is None else df.join(hot, list(group), "left_anti")
    out = calm.groupBy(*group).agg(*more, *[F.sort_array(F.collect_list(c)).alias(f"_s_{m}") for m, c in values.items()])
    for m in values:
        out = out.withColumn("n", F.size(f"_s_{m}").cast("bigint")).withColumns({f"{m}_{k}": F.get(f"_s_{m}", r.cast("int")) for k, r in ranks.items()})
        out = out.withColumnRenamed("n", f"{m}_n").drop(f"_s_{m}")
    if hot is None:
        return out
    warm = df.join(hot, list(group), "left_semi")
    found = warm.groupBy(*group).agg(*more, *[F.count(c).alias(f"{m}_n") for m, c in values.items()])
    for m, c in values.items():
        one = _radix_ranks(warm.where(F.col(c).isNotNull()).select(*group, F.col(c).alias("_v")), group, ranks, limit).drop("n")
        found = found.join(one.withColumnsRenamed({k: f"{m}_{k}" for k in ranks}), list(group), "left")
    return out.unionByName(found)


def ranked_values(df: DataFrame, group: Sequence[str], value: str, ranks: dict[str, Column], limit: int = RANK_ROWS) -> DataFrame:
    """``group, n`` and each rank of one column, for the groups that have a value."""
    out = ranked_columns(df.where(F.col(value).isNotNull()), group, {"v": value}, ranks, limit=limit)
    return out.select(*group, F.col("v_n").alias("n"), *[F.col(f"v_{k}").alias(k) for k in ranks])


def nearest_rank(p: float) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.lit(p) * F.col("n")) - 1)


def rounded_rank(p: float) -> Column:
    return F.least(F.col("n") - 1, F.greatest(F.lit(0), F.rint(F.lit(p) * (F.col("n") - 1)).cast("bigint")))
