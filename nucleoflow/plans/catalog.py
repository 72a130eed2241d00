"""All registered queries."""

from nucleoflow.plans import (  # noqa: F401
    queries_cluster,
    queries_labels,
    queries_matching,
    queries_network,
    queries_qc,
    queries_trajectory,
)
from nucleoflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
