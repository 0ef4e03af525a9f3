"""All registered queries of the graph engine and their SQL."""

from __future__ import annotations

from lattice.plans import fragments, queries, tables

QUERIES: dict = {**queries.QUERIES, **tables.QUERIES, **fragments.QUERIES}
ORACLES: dict[str, str] = {**queries.ORACLES, **tables.ORACLES, **fragments.ORACLES}
