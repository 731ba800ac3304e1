"""All registered queries with the SQL that gives the same rows."""

from evtspark.plans import match_plans, model_plans, selection_plans, signal_plans, source_plans, stats_plans, summary_plans, time_plans  # noqa: F401
from evtspark.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "a3_psth"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
