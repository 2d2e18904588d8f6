"""All registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_aggregates, q_assembly, q_blocks, q_children, q_choices, q_features, q_models, q_sequences, q_slices, q_tables

MODULES = [q_aggregates, q_sequences, q_features, q_tables, q_blocks, q_children, q_choices, q_models, q_slices, q_assembly]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
