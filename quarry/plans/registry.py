"""All queries of the engine itself, and the SQL they are checked against."""

from quarry.plans import evaluation, lifecycle, retrieval, state, text

_PLANS = (retrieval, evaluation, text, state, lifecycle)
QUERIES = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
