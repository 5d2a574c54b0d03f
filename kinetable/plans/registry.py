"""Query registry: a callable per query and, where SQL can say it, the same result as DuckDB SQL."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def cte(name: str, sql: str) -> None:
    """Named SQL building block of the oracles."""
    CTES[name] = sql


def _mentions(sql: str) -> set[str]:
    return {n for n in CTES if re.search(rf"\b{n}\b", sql)}


@functools.lru_cache(maxsize=None)
def mentioned(text: str) -> frozenset[str]:
    """Building blocks in a text; all of them are defined by the time this is asked."""
    return frozenset(_mentions(text)) - {n for n, body in CTES.items() if body == text}


def resolved(sql: str, recursive: bool = False) -> str:
    """Prefix ``sql`` with the building blocks it mentions, each behind those that it builds on."""
    ordered: dict[str, None] = {}

    def place(text: str) -> None:
        for other in CTES:
            if other in mentioned(text) and other not in ordered:
                place(CTES[other])
                ordered[other] = None

    place(sql)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered]
    body = sql.strip()
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if head:
        recursive = recursive or bool(head.group(1))
        parts.append(body[head.end():])
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts)
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + body


def oracle_sql() -> dict[str, str]:
    return {name: resolved(sql) for name, sql in ORACLES.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Derived doubles are compared at six digits; ``+ 0.0`` folds negative zero.

    ``nudge`` moves values that sit exactly on a rounding tie, where the two engines differ.
    """
    return df.withColumns({c: F.round(F.col(c) + F.lit(nudge), digits) + F.lit(0.0) for c in columns})
