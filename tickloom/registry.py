"""All registered market queries and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "slice_vwap_leaders"


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


from .plans import audit_plans, calendar_plans, chain_plans, feature_plans, file_plans, intake_plans, join_plans, label_plans, ledger_plans, model_plans, option_plans, outcome_plans, path_plans, quality_plans, rule_plans, select_plans, stat_plans, stream_plans, study_plans  # noqa: E402, F401
