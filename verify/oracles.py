"""SQL for every registered query that SQL can express."""

from __future__ import annotations

from verify import o_decisions, o_evaluate, o_features, o_joins, o_sources, o_streaming

SQL: dict[str, str] = {}
for _module in (o_features, o_decisions, o_sources, o_joins, o_evaluate, o_streaming):
    SQL.update(_module.SQL)

# Engine types that differ in width from Spark's result: query -> column -> type.
CASTS = {
    "r_by_category": {"points": "bigint"}, "r_custom": {"points": "bigint"}, "sink_reports": {"fraud": "bigint"},
    "canon_mobile_money": {c: "double" for c in ("latitude", "longitude", "home_latitude", "home_longitude")},
    "canon_ecommerce": {c: "double" for c in ("latitude", "longitude", "home_latitude", "home_longitude")},
    "union_sources": {"fraud": "bigint"}, "table_counts": {"n": "bigint"}, "j_interval_history": {"cents": "bigint"},
    "split_summary": {"fraud": "bigint"}, "m_tiers": {"fraud": "bigint"},
    "imb_class_weight": {"pos": "bigint", "neg": "bigint"}, "replay_ordered": {"fraud": "bigint"},
    "ledger_reconcile": {"total_input": "bigint", "duplicates": "bigint"},
}
for _name, _columns in CASTS.items():
    _list = ", ".join(f"cast({c} as {t}) as {c}" for c, t in _columns.items())
    SQL[_name] = f"select * replace ({_list}) from ({SQL[_name]})"
