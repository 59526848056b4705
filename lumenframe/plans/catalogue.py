"""The named queries of the library and the SQL that says the same.

Each module of queries holds pairs: a function of (session, folder) and, where SQL can express it, its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_cluster, q_eda, q_files, q_ml, q_profile, q_recipe

_MODULES = (q_profile, q_recipe, q_eda, q_ml, q_cluster, q_files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
