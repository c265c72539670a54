"""All registered queries of the engine."""

from __future__ import annotations

from . import catalog_commands, catalog_hexagons, catalog_joins, catalog_listings, catalog_media, catalog_more, catalog_reports, catalog_series, catalog_state
from .views import Query

_PARTS = (catalog_series, catalog_reports, catalog_state, catalog_more, catalog_listings, catalog_commands, catalog_joins, catalog_hexagons, catalog_media)
QUERIES: dict[str, Query] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE.items()}
