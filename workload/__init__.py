"""Registered queries over the test tables, with a SQL statement of each expected result."""

from workload import (  # noqa: F401
    cell_queries, hotspot_queries, layer_queries, load_queries, quality_queries, statistic_queries,
)
from workload.registry import EXPECTED, QUERIES  # noqa: F401
