"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join back, so a vertex with a third of all links is
split by Spark's skew handling like any other hot key. Each round is written to the
shared folder; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import materialize


def _signature(links: DataFrame):
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(links: DataFrame, files: int = 8) -> DataFrame:
    """``u, v`` (any direction) -> ``node, root``: the smallest node that links reach, for nodes that are not roots.

    Each round is written as ``files`` files, by as many tasks.
    """
    keep = lambda df: materialize(df.distinct().repartition(files))
    stars = keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    before = _signature(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every link now points from the larger to the smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = keep(small.unionByName(low.select("u", F.col("m").alias("v"))))
        after = _signature(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
