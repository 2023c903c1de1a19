"""All queries of the library and their oracle SQL, by name."""

from __future__ import annotations

from gaugeworks.plans import audit_queries, availability_queries, causal_queries, cluster_queries, comparison_queries, corroboration_queries, detection_queries, evidence_queries, forecast_queries, hazard_queries, health_queries, ratio_queries, reason_queries, selection_queries, serving_queries, split_queries

_PARTS = (audit_queries, availability_queries, causal_queries, cluster_queries, comparison_queries, corroboration_queries, detection_queries, evidence_queries, forecast_queries, hazard_queries, health_queries, ratio_queries, reason_queries, selection_queries, serving_queries, split_queries)


def queries():
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql():
    return {name: q for part in _PARTS for name, q in part.ORACLE_SQL.items()}
