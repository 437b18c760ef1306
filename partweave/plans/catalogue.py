"""All queries of the part-hierarchy operators, by name."""

from __future__ import annotations

from partweave.plans import cell_queries, export_queries, feature_queries, graph_queries, grouping_queries, inference_queries, library_queries, object_queries, scalar_queries, spatial_queries, stream_queries, structure_queries, variant_queries  # noqa: F401
from partweave.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
