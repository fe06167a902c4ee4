"""All registered queries."""

from plumbline.plans import (  # noqa: F401
    cleaning_queries,
    entity_queries,
    history_queries,
    open_checks,
    planted_queries,
    profile_queries,
    rule_queries,
    value_queries,
)
from plumbline.plans.registry import QUERIES

__all__ = ["QUERIES"]
