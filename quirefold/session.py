"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


_FOLDERS: set[str] = set()


def local_session(app: str = "quirefold", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where a session does not name one, as in tests, it is set to a folder in the
    warehouse, which is shared as well. The folder goes when the driver's process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/quirefold-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder through Spark's file systems, if the session still lives."""
    if spark.sparkContext._jsc is None:
        return
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    except (Py4JError, OSError):
        return


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the scratch folder, with the writer's ``options``, and read it back.

    Unlike an in-memory cache this survives the loss of an executor, and unlike
    an RDD checkpoint it computes the plan once and stays columnar.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
