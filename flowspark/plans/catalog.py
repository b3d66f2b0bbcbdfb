"""All registered queries."""

from flowspark.plans import (  # noqa: F401
    decision_queries, feature_queries, flagship, packet_queries, report_queries, sample_queries,
    stream_queries,
)
from flowspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
