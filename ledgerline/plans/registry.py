"""All queries and their oracles, by name."""

from __future__ import annotations

from ledgerline.plans import code_queries, event_queries, experiment_queries, history_queries, rule_queries, screen_queries, text_queries, vector_queries

FLAGSHIP = "gate_benchmark"
MODULES = [event_queries, vector_queries, text_queries, experiment_queries, rule_queries, history_queries, screen_queries, code_queries]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
