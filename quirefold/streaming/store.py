"""What streams keep below a folder: nothing is forgotten, so no watermark decides what counts.

Tables are levels of runs (``levels``): a trigger opens only the folders that may hold its
keys, and a trigger that is replayed adds nothing a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import materialize
from quirefold.streaming.levels import LevelledTable, layout_of, newest
from quirefold.streaming.runner import new_folder


def each_trigger(stream: DataFrame, root: str, settle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(settle).outputMode(mode).option("checkpointLocation", f"{root}/_state").trigger(availableNow=True).start())
    query.awaitTermination()


def first_of_each(stream: DataFrame, keys: Sequence[str], order: Sequence[str], root: str | None = None) -> DataFrame:
    """The row of each key that comes first in ``order`` among all that ever arrive, in whatever order they do.

    A trigger keeps the rows that beat what is stored for their key; readers take the best.
    """
    spark = stream.sparkSession
    best = F.min(F.struct(*order, F.struct("*").alias("_row")))
    firsts = lambda rows: rows.groupBy(*keys).agg(best.alias("_b")).select("_b._row.*")
    table = LevelledTable(spark, root or new_folder(spark, "first"), layout_of(stream), keys, firsts)

    def settle(batch: DataFrame, number: int) -> None:
        if table.settled(number):
            return
        won = materialize(firsts(batch))
        held = table.holding(won, number).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_held"))
        beaten = F.col("_held").isNotNull() & (F.struct(*order) >= F.col("_held"))
        table.add(won.join(held, list(keys), "left").where(~beaten).select(*stream.columns), number)

    each_trigger(stream, table.root, settle)
    return firsts(table.rows())


def refolded(stream: DataFrame, keys: Sequence[str], fold: Callable[[DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """``fold`` of everything a key has ever sent, brought up to date for the keys each trigger touches.

    Events may arrive in any order and any trigger: a touched key is folded again from its
    stored rows, so the answer is the one the batch operator gives.
    """
    spark = stream.sparkSession
    root = root or new_folder(spark, "refolded")
    out = layout_of(fold(spark.createDataFrame([], stream.schema)))
    log = LevelledTable(spark, f"{root}/log", layout_of(stream), keys)
    # a touched key that folds to nothing leaves its mark, so that older results of it do not count
    results = LevelledTable(spark, f"{root}/results", f"{out}, _version bigint, _mark boolean", keys, lambda rows: newest(rows, keys))

    def settle(batch: DataFrame, number: int) -> None:
        batch = materialize(batch)
        if not log.settled(number):
            log.add(batch, number)
        if results.settled(number):
            return
        fresh = materialize(batch.select(*keys).distinct())
        earlier = log.holding(fresh, number).join(fresh, list(keys), "left_semi").select(*stream.columns)
        folded = fold(earlier.unionByName(batch)).withColumn("_mark", F.lit(False))
        marked = folded.unionByName(fresh.withColumn("_mark", F.lit(True)), allowMissingColumns=True)
        results.add(marked.withColumn("_version", F.lit(number).cast("bigint")), number)

    each_trigger(stream, root, settle)
    return newest(results.rows(), keys).where("NOT _mark").drop("_version", "_mark")


def upserted(stream: DataFrame, keys: Sequence[str], root: str | None = None) -> DataFrame:
    """A streaming aggregate as a table: each trigger writes the groups it changed, and only those."""
    spark = stream.sparkSession
    table = LevelledTable(spark, root or new_folder(spark, "upserted"), f"{layout_of(stream)}, _version bigint", keys, lambda rows: newest(rows, keys))

    def settle(batch: DataFrame, number: int) -> None:
        if not table.settled(number):
            table.add(materialize(batch).withColumn("_version", F.lit(number).cast("bigint")), number)

    each_trigger(stream, table.root, settle, "update")
    return newest(table.rows(), keys).drop("_version")
