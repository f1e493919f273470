"""Streaming twins of ingest registration."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quirefold.streaming.store import first_of_each


def idempotent_batches(batches: DataFrame, root: str | None = None) -> DataFrame:
    """The batch that each (ws, idempotency_key) resolves to: the first ever asked for, by time, then id."""
    return first_of_each(batches.where("idempotency_key IS NOT NULL"), ("ws", "idempotency_key"), ("created_at", "id"), root)


def register_assets(uploads: DataFrame, existing: DataFrame, root: str | None = None) -> DataFrame:
    """Register each content once, ever, unless ``existing`` has it; the first arrival gives the row."""
    first = first_of_each(uploads, ("ws", "sha256"), ("arrival", "id"), root)
    return first.join(existing.select("ws", "sha256"), ["ws", "sha256"], "left_anti").select(*uploads.columns)
