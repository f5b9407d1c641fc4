"""All queries on the reference's operators."""

from __future__ import annotations

from . import constraints, local, logs, outbound, reads, rest, rounds
from .registry import ORACLES, QUERIES, Query

MODULES = (logs, reads, constraints, outbound, rest, local, rounds)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
