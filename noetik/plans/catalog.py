"""Registry of the engine's own queries."""

from __future__ import annotations

from . import asking, derived, knowledge, lifecycle, model, names, ranked, retrieval, similar, streams, upkeep  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
