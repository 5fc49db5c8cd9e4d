"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from . import checks, evaluation, evidence, graph, lifecycle, memory, payloads, public, quality, retrieval, service, source, stores, streams, traces, trees  # noqa: F401  (each registers its queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
