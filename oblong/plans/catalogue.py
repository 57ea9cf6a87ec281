"""All queries of the layout engine and their SQL for the independent check."""

from __future__ import annotations

from oblong.plans import bench_queries, extension_queries, file_queries, geometry_queries, grid_queries, layout_queries, model_queries, more_queries, plan_queries, polygon_queries, repair_queries, stream_queries, table_queries  # noqa: F401  they register their queries
from oblong.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
