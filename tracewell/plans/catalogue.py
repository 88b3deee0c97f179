"""All queries of the core, by name, with their SQL where SQL can say it."""

from __future__ import annotations

from tracewell.plans import activity_queries, posture_queries, scan_queries, snapshot_queries, source_queries, supply_queries

FLAGSHIP = "q_scan_documents"
_PARTS = [snapshot_queries, scan_queries, activity_queries, supply_queries, posture_queries, source_queries]

QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE = {k: s for part in _PARTS for k, s in part.ORACLE.items()}
