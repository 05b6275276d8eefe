"""All queries of the engine, and the SQL that checks them."""

from __future__ import annotations

from folioflow.plans import catalog_formats, catalog_parts, catalog_service, catalog_tables, catalog_text

_PARTS = (catalog_text, catalog_tables, catalog_service, catalog_formats, catalog_parts)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.ORACLES.items()}
