"""Commit manifests: several tables change together, once, or not at all.

A commit stages the files of every table it adds to in a folder of its own and then
publishes one small manifest that names them. Readers follow manifests, so a commit that
died between two tables, or before its manifest, is not there. A commit has an id; one that
is published already is left alone, so a retry after a lost answer adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FOLDER = "_commits"


def _files(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def read_document(spark: SparkSession, where: str) -> dict | None:
    """A small JSON document, or None where there is none."""
    path, files = _files(spark, where)
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def publish_document(spark: SparkSession, where: str, document: dict) -> bool:
    """Write a document under a new name and move it into place whole; False when the name is taken."""
    path, files = _files(spark, where)
    if files.exists(path):
        return False
    draft, _ = _files(spark, f"{path.getParent().toString()}/.{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(document, sort_keys=True).encode()))
    finally:
        stream.close()
    if files.exists(path) or not files.rename(draft, path):
        files.delete(draft, False)
        return False
    return True


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Published documents of a folder; drafts begin with a dot."""
    path, files = _files(spark, folder)
    if not files.exists(path):
        return []
    return sorted(n for s in files.listStatus(path) if not (n := s.getPath().getName()).startswith("."))


def append_together(root: str, commit: str, tables: Mapping[str, DataFrame]) -> bool:
    """Add rows to several tables below ``root`` in one commit; False when it is in already."""
    if "/" in commit or commit.startswith(".") or not commit:
        raise ValueError(f"{commit!r} cannot name a commit")
    spark = next(iter(tables.values())).sparkSession
    manifest = f"{root}/{FOLDER}/{commit}"
    if read_document(spark, manifest) is not None:
        return False
    staged = {name: f"{name}/{uuid.uuid4().hex}" for name in tables}
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{root}/{staged[name]}")
    return publish_document(spark, manifest, {"tables": staged})


def read_committed(spark: SparkSession, root: str, table: str, schema: StructType) -> DataFrame:
    """All rows that published commits have added to a table."""
    documents = [read_document(spark, f"{root}/{FOLDER}/{n}") for n in names_in(spark, f"{root}/{FOLDER}")]
    folders = [f"{root}/{d['tables'][table]}" for d in documents if d and table in d["tables"]]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)
