"""All registered queries and their SQL."""

from __future__ import annotations

from . import cells, chains, curves, learning, mapping, overlay, pixels, sampling, scoring, storage, utility  # noqa: F401
from .registry import QUERIES, SQL


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["QUERIES", "SQL", "oracle_sql"]
