"""All queries of the library outside the training-data subpackage, and their DuckDB SQL."""

from __future__ import annotations

from millrace.plans import (
    catalogue_queries, decision_queries, loop_queries, monitor_queries, ontology_queries, profile_queries, series_queries, stream_queries, text_queries,
)

FLAGSHIP = "control_chart"
MODULES = (series_queries, profile_queries, decision_queries, monitor_queries, ontology_queries, text_queries, loop_queries, catalogue_queries, stream_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
