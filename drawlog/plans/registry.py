"""All registered queries and their check SQL."""

from __future__ import annotations

from drawlog.plans import q_assets, q_catalog, q_export, q_functions, q_geometry, q_ingest, q_stream, q_surface, q_tiles

_MODULES = [q_ingest, q_functions, q_surface, q_geometry, q_tiles, q_catalog, q_assets, q_export, q_stream]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
