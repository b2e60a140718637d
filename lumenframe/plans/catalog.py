"""All registered queries and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from lumenframe.plans import brick_queries, mixed_queries, table_queries, volume_queries

FLAGSHIP = "suv_consistency_pipeline"
QUERIES: dict[str, Callable] = {**volume_queries.Q, **brick_queries.Q, **mixed_queries.Q, **table_queries.Q}
ORACLE_SQL: dict[str, str] = {**volume_queries.SQL, **brick_queries.SQL, **mixed_queries.SQL, **table_queries.SQL}
