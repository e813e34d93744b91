"""Registry of queries and, next to each, the SQL text that checks it."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keeprank.catalog.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = [
    "projections", "sources", "joins", "aggregates", "windows", "rankings", "vectors", "learning",
    "recommendation", "streams",

]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the view definitions it refers to, dependencies first."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                need_inner = re.sub(rf"\b{name}\b", "", VIEWS[name])
                need(need_inner)
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    if not ordered:
        return sql
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    body = sql.strip()
    recursive = bool(re.match(r"with\s+recursive\b", body, re.I))
    if re.match(r"with\b", body, re.I):
        body = re.sub(r"^with(\s+recursive)?\s+", "", body, count=1, flags=re.I)
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{body}"
    return f"WITH {head}\n{body}"


def query(key: str, sql: str | None = None):
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn

    return register


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"keeprank.catalog.{name}")
