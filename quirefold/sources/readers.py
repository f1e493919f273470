"""Readers: ledger tables, the release log, benchmark samples, label maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold import schemas as S
from quirefold.sources.commits import read_committed

# Layout of one raw benchmark file.
TRIAL_FILE = (
    "config STRING, trial BIGINT, summary STRUCT<throughput_pages_per_s: DOUBLE, peak_rss_bytes: BIGINT, steady_rss_bytes: BIGINT, n_pages: BIGINT>, "
    "samples ARRAY<STRUCT<page_id: STRING, queue_inclusive_ms: DOUBLE, service_ms: DOUBLE, preprocess_ms: DOUBLE, infer_ms: DOUBLE, "
    "postprocess_ms: DOUBLE, peak_rss: BIGINT>>"
)


class EmptyLabelMap(ValueError):
    """A configuration without any label."""


def load_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """One ledger table with its declared types; files name the workspace column ``workspace_id``."""
    declared = S.schema(table)
    stored = [("workspace_id" if f.name == "ws" else f.name, f.dataType) for f in declared]
    ddl = ", ".join(f"{n} {t.simpleString()}" for n, t in stored)
    return spark.read.schema(ddl).format(fmt).load(f"{path}/{table}").withColumnsRenamed({"workspace_id": "ws"})


def load_table_jdbc(spark: SparkSession, url: str, table: str, partition_on: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> DataFrame:
    """The same over JDBC; give a numeric column and its bounds to read in parallel slices."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_on is not None and bounds is not None:
        reader = reader.options(partitionColumn=partition_on, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    raw = reader.load().withColumnsRenamed({"workspace_id": "ws"})
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.schema(table) if f.name in raw.columns])


def release_log(spark: SparkSession, root: str, table: str = "release") -> DataFrame:
    """``release`` or ``audit_event`` rows of every commit to the log below ``root``."""
    stored = T.StructType([T.StructField("workspace_id" if f.name == "ws" else f.name, f.dataType) for f in S.schema(table)])
    return read_committed(spark, root, table, stored).withColumnsRenamed({"workspace_id": "ws"})


def bench_samples(spark: SparkSession, root: str, pretty: bool = True) -> DataFrame:
    """One row per page sample from a folder of trial files.

    ``pretty`` files hold one indented document each; otherwise one document per line.
    """
    trials = spark.read.schema(TRIAL_FILE).option("multiLine", str(pretty).lower()).json(root)
    return trials.select("config", "trial", F.posexplode("samples").alias("pos", "_s")).select("config", "trial", "pos", "_s.*")


def label_map(frame: DataFrame, column: str, keys: Sequence[str], check: bool = False) -> DataFrame:
    """``id2label`` of a configuration as (class_id, label) rows."""
    parsed = F.from_json(column, "struct<id2label:map<string,string>>")["id2label"]
    rows = frame.select(*keys, F.explode(F.map_entries(parsed)).alias("_e")).select(
        *keys, F.col("_e.key").cast("int").alias("class_id"), F.col("_e.value").alias("label"))
    if check and not frame.select(parsed.alias("m")).where(F.col("m").isNull() | (F.size("m") == 0)).isEmpty():
        raise EmptyLabelMap("a configuration has no labels")
    return rows
