"""Runnable plans: each operator over the given tables, with an equivalent SQL statement where one exists."""

from vitalweave.plans import clinical, cohorts, models, privacy, reports, scalars, streams
from vitalweave.plans.registry import PLANS

__all__ = ["PLANS", "clinical", "cohorts", "models", "privacy", "reports", "scalars", "streams"]
