"""Name of query -> Spark callable and DuckDB twin, over the driver's tables."""

from sparkmine.plans import baskets, clusters, graphs, layers, spread, texts, vectors  # noqa: F401
from sparkmine.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
