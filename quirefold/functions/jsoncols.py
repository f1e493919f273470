"""JSON text columns decoded with explicit schemas and typed defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETECTION = "struct<class_id:int,label:string,score:double,box:array<double>>"


def decode(text: Column | str, schema: str, default: Column | None = None) -> Column:
    """NULL or malformed text gives the default (an empty array for array schemas)."""
    text = F.col(text) if isinstance(text, str) else text
    parsed = F.from_json(text, schema)
    if default is None and schema.startswith("array<"):
        default = F.from_json(F.lit("[]"), schema)
    return parsed if default is None else F.coalesce(parsed, default)


def detection_rows(frame: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """One row per usable detection, under its position in the stored text."""
    placed = frame.select(*keys, F.posexplode(decode(column, f"array<{DETECTION}>")).alias("pos", "_d"))
    return placed.where(_usable()).select(
        *keys, "pos", "_d.class_id", "_d.label", "_d.score",
        *[F.col("_d.box")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
    )


def _usable() -> Column:
    return F.coalesce(F.col("_d.label").isNotNull() & (F.size("_d.box") == 4), F.lit(False))


def detection_faults(frame: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Position and reason of every stored detection that ``detection_rows`` leaves out."""
    placed = frame.select(*keys, F.posexplode(decode(column, f"array<{DETECTION}>")).alias("pos", "_d"))
    return placed.where(~_usable()).select(*keys, "pos", F.when(F.col("_d.label").isNull(), "no_label").otherwise("no_box").alias("reason"))


def encode_detections(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inverse: detection rows back to one JSON text per key, in position order."""
    entry = F.struct("pos", F.struct("class_id", "label", "score", F.array("x1", "y1", "x2", "y2").alias("box")).alias("d"))
    return frame.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_e")).select(
        *keys, F.to_json(F.transform("_e", lambda e: e["d"])).alias("detections"), F.size("_e").alias("n_detections"))
