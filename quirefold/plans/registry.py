"""All registered queries and oracles."""

from __future__ import annotations

from importlib import import_module

AREAS = ["q_detect", "q_catalog", "q_ledger", "q_latency", "q_bench", "q_gates", "q_ingest", "q_datasets", "q_stream"]

QUERIES: dict = {}
ORACLES: dict = {}
for _area in AREAS:
    _m = import_module(f"quirefold.plans.{_area}")
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
