"""All registered queries."""

from varigrade.plans import queries_features, queries_metrics, queries_models, queries_tables  # noqa: F401
from varigrade.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
