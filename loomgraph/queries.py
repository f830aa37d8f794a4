"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from loomgraph.plans import queries_graph, queries_io, queries_link, queries_text  # noqa: F401
from loomgraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
