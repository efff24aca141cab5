"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from rallyframe.plans import detection_queries, misc_queries, pixel_queries, record_queries, track_queries, tracker_queries

_MODULES = (track_queries, detection_queries, tracker_queries, pixel_queries, record_queries, misc_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
