"""All queries of the core with their SQL, by the ids of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from mendframe.plans import corpus_queries, episode_queries, function_queries, kernel_queries

_MODULES = [kernel_queries, corpus_queries, episode_queries, function_queries]
QUERIES: dict[str, Callable] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
