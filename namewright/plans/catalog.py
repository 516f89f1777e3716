"""The registered queries of the reference-style operators and their DuckDB counterparts."""

from __future__ import annotations

from namewright.plans import names, scans, scans_sql

QUERIES: dict = {**names.QUERIES, **scans.QUERIES}
ORACLES: dict[str, str] = {**names.ORACLES, **scans_sql.ORACLES}
