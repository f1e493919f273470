"""Drive a stream over everything that is available and hand back the sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quirefold.session import scratch_root


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Append-mode stream into a parquet folder, checkpointed beside it."""
    spark = stream.sparkSession
    root = new_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/_state")
        .option("path", f"{root}/rows").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
