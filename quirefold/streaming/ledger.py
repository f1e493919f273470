"""Streaming twins of the ledger operators.

The event log is stored and the items a trigger touches are folded again by the batch
operators, so events may arrive in any order. Arrivals of micro-batches are taken in
trigger order, which is what an arrival is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold import constants as K
from quirefold.operators import ledger as L
from quirefold.operators.ordering import position
from quirefold.session import materialize
from quirefold.streaming.runner import new_folder
from quirefold.streaming.store import first_of_each, refolded

ITEM = ("ws", "item_id")


def fenced_writes(events: DataFrame, root: str | None = None) -> DataFrame:
    return refolded(events, ITEM, L.fenced_writes, root)


def item_state_fold(events: DataFrame, root: str | None = None) -> DataFrame:
    return refolded(events, ITEM, L.item_state_fold, root)


def lease_extend(events: DataFrame, root: str | None = None) -> DataFrame:
    return refolded(events, ITEM, L.lease_extend, root)


def unique_predictions(predictions: DataFrame, root: str | None = None) -> DataFrame:
    """First prediction per (item, candidate), ever."""
    return first_of_each(predictions, ("ws", "work_item_id", "candidate_id"), ("id",), root)


def micro_batches(
    arrivals: DataFrame, size: int = K.MAX_BATCH, window_ms: int = K.BATCH_WINDOW_MS, key: str = "pool", root: str | None = None,
) -> DataFrame:
    """Batches over a drained stream, the unfinished last one of each key as ``flush``.

    A trigger sees its own arrivals and those of the batch left open before it, and cuts
    both with the batch operator; closed batches are final.
    """
    spark = arrivals.sparkSession
    root = root or new_folder(spark, "micro")
    slim = arrivals.select(key, "at_ms", "item")
    rows_of = ", ".join(f"`{n}` {t}" for n, t in slim.dtypes)
    kind = dict(slim.dtypes)[key]
    cut_of = f"`{key}` {kind}, start_pos bigint, n bigint, closed_by string, waited_ms bigint, first_at_ms bigint"

    def at(folder: str, layout: str, number: int) -> DataFrame:
        """What trigger ``number`` left behind; nothing before the first."""
        return spark.read.schema(layout).parquet(f"{root}/{folder}/{number}") if number >= 0 else spark.createDataFrame([], layout)

    def settle(batch: DataFrame, number: int) -> None:
        before = at("open", rows_of, number - 1)
        base = at("done", f"`{key}` {kind}, done bigint", number - 1)
        rows = materialize(batch.unionByName(before))
        cut = materialize(L.micro_batches(rows, size, window_ms, key).join(base, key, "left").withColumn("_base", F.coalesce("done", F.lit(0))).drop("done"))
        final = cut.where("closed_by <> 'flush'").withColumn("start_pos", F.col("start_pos") + F.col("_base")).drop("_base")
        final.write.mode("overwrite").parquet(f"{root}/cut/{number}")
        ended = final.groupBy(key).agg(F.sum("n").alias("_n"))
        done = base.join(ended, key, "full").select(key, (F.coalesce("done", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("done"))
        done.write.mode("overwrite").parquet(f"{root}/done/{number}")
        left = cut.where("closed_by = 'flush'").select(key, F.col("start_pos").alias("_from"))
        placed = position(rows, [key], [F.col("at_ms"), F.col("item")], "_pos").join(left, key).where(F.col("_pos") - 1 >= F.col("_from"))
        placed.select(key, "at_ms", "item").write.mode("overwrite").parquet(f"{root}/open/{number}")
        spark.createDataFrame([(number,)], "number bigint").write.mode("overwrite").parquet(f"{root}/settled/_trigger={number}")

    query = slim.writeStream.foreachBatch(settle).option("checkpointLocation", f"{root}/_state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([(-1,)], "number bigint").write.mode("overwrite").parquet(f"{root}/settled/_trigger=-1")
    last = spark.read.parquet(f"{root}/settled").agg(F.max("number")).first()[0]
    if last < 0:
        return spark.createDataFrame([], cut_of)
    closed = spark.read.schema(cut_of).parquet(f"{root}/cut/*")
    flushed = L.micro_batches(at("open", rows_of, last), size, window_ms, key).join(at("done", f"`{key}` {kind}, done bigint", last), key, "left")
    return closed.unionByName(flushed.withColumn("start_pos", F.col("start_pos") + F.coalesce("done", F.lit(0))).drop("done"))
