"""The registered queries outside the llm subpackage, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import knowledge, notes, reports
from .queries import QUERIES
from .sql import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | notes.QUERIES | reports.QUERIES | knowledge.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | notes.ORACLES | reports.ORACLES | knowledge.ORACLES
