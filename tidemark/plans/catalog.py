"""Query catalogue: each entry pairs a Spark query with its SQL oracle (None: rows and tests only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, tables: str = "", name: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``tables`` names the derived tables that its oracle reads."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            with_ = f"WITH {fixtures.cte(*tables.split())}" if tables else ""
            body = oracle.strip()
            if with_ and body.upper().startswith("WITH "):
                body = ",\n" + body[5:]
            ORACLES[key] = f"{with_}\n{body}".strip()
        return f

    return add
