"""Named queries over the given tables, each with an equivalent SQL text where one exists."""

from registry import evaluation, features, insights, profile, sources, targets

_MODULES = [sources, profile, targets, features, evaluation, insights]


def all_queries() -> dict:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
