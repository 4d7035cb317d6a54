"""All registered queries by name."""

from __future__ import annotations

from riskspark.plans import q_decisions, q_evaluate, q_features, q_joins, q_models, q_sources, q_streaming, q_workflow

QUERIES = {}
for _module in (q_features, q_decisions, q_sources, q_joins, q_workflow, q_evaluate, q_models, q_streaming):
    QUERIES.update(_module.QUERIES)
