"""All registered raster queries: importing the modules registers them."""

from __future__ import annotations

from gridspark.plans import kernel_queries, map_queries, object_queries, refine_queries, registry, report_queries, route_queries, tile_queries  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
