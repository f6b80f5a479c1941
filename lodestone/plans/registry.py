"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import control, documents, lexical, matching, operations, provenance, records, search  # noqa: F401  each registers its queries
from .catalog import ORACLES, QUERIES, Query

FLAGSHIP = "exact_search_minimum_slice"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
