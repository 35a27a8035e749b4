"""The registered queries of the core and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["q_text", "q_search", "q_urls", "q_state", "q_sources", "q_media", "q_pages"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"loomspan.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"loomspan.plans.{name}").SQL
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(queries().values()))(spark, sf_dir)
