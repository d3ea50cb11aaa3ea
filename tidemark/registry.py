"""All queries of the file-collection operators and their SQL oracles."""

from __future__ import annotations

from tidemark.plans import core, events, lifecycles, namespaces  # noqa: F401  (they register their queries)
from tidemark.plans.catalog import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
