"""The registered queries of the ten training-data problems and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["p01_residue", "p02_spam_pages", "p03_near_duplicates", "p04_encoding", "p05_site_lines", "p06_main_body", "p07_addresses", "p08_packing", "p09_mixing", "p10_truncation"]


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"loomspan.llm.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"loomspan.llm.{name}"), "SQL", {})
    return out
