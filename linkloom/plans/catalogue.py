"""All queries of the engine by name, with their DuckDB equivalents.

The driver tables hold no business records, so operators run on stand-ins: suppliers, customers, parts and
orders play entities and records, lineitem plays scored pairs (record: order, entity: supplier).
"""

from __future__ import annotations

from linkloom.plans import q_decisions, q_inspect, q_models, q_pairs, q_retrieval, q_tables, q_text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (q_retrieval, q_decisions, q_text, q_pairs, q_tables, q_inspect, q_models):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
