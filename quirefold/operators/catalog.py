"""Scoped lookups, pagination and catalogue listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, ws: str) -> DataFrame:
    return df.where(F.col("ws") == ws)


def page_with_asset(pages: DataFrame, assets: DataFrame) -> DataFrame:
    a = assets.select("ws", F.col("id").alias("asset_id"), "sha256", "provenance", "synthetic")
    return pages.join(a, ["ws", "asset_id"])


def list_page(df: DataFrame, after: str | None, limit: int = 100, key: str = "id") -> DataFrame:
    """Keyset pagination; the page size is clamped to 1..500."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(max(1, min(int(limit), 500)))


def recent(df: DataFrame, limit: int = 50, most: int = 200) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.asc("id")).limit(min(limit, most))


def release_history(releases: DataFrame, candidates: DataFrame, limit: int = 50) -> DataFrame:
    """Per channel, the newest releases first; the rank filter runs before the shuffle."""
    newest = Window.partitionBy("ws", "channel_id").orderBy(F.desc("created_at"), F.desc("id"))
    top = releases.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)
    names = candidates.select("ws", F.col("id").alias("candidate_id"), F.col("name").alias("candidate_name"))
    return top.join(names, ["ws", "candidate_id"], "left")


def newest_per(df: DataFrame, keys: list[str], by: Column | None = None) -> DataFrame:
    order = [F.desc("created_at"), F.desc("id")] if by is None else [by.desc(), F.desc("id")]
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")


def latest_dataset_version(datasets: DataFrame, semver: str | None = None) -> DataFrame:
    if semver is not None:
        return newest_per(datasets.where(F.col("semver") == semver), ["ws", "name"])
    return newest_per(datasets, ["ws", "name"])


def latest_evaluation(evaluations: DataFrame) -> DataFrame:
    return newest_per(evaluations.where(F.col("status") == "done"), ["ws", "candidate_id"])


def object_keys_for(pages: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = ids.select("ws", F.col("page_id").alias("id"))
    return pages.join(wanted, ["ws", "id"], "left_semi").select("ws", "id", "object_key")


def dataset_page_ids(truth: DataFrame, dataset: str, split: str) -> DataFrame:
    return truth.where((F.col("dataset") == dataset) & (F.col("split") == split)).select("ws", "page_id").distinct()


def visible_class_counts(detections: DataFrame, slider: float, keys: list[str]) -> DataFrame:
    return (
        detections.where(F.col("score") >= slider).groupBy(*keys, "label").agg(F.count("*").alias("n"))
        .orderBy(*keys, F.desc("n"), "label")
    )
