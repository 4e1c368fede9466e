"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

from . import bench_queries, case_queries, detection_queries, edit_queries, evidence_queries, extension_queries, file_queries, identity_queries, scalar_queries, suppression_queries, track_queries, training_queries, transcript_queries  # noqa: F401  (they register themselves)
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
