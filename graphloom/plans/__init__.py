"""All registered queries over the projected graph."""

from graphloom.plans import graph_queries, lookup_queries, more_queries, resolution_queries  # noqa: F401
from graphloom.plans.registry import ORACLES, QUERIES  # noqa: F401
