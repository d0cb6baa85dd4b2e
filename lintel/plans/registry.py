"""Collects the named queries of the library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of lintel.plans that each define QUERIES and ORACLES.
PLAN_MODULES: tuple[str, ...] = ("text_plans", "linkage_plans", "panel_plans", "document_plans", "record_plans", "stream_plans", "listing_plans", "file_plans")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in PLAN_MODULES:
        out.update(import_module(f"lintel.plans.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in PLAN_MODULES:
        out.update(import_module(f"lintel.plans.{name}").ORACLES)
    return out
