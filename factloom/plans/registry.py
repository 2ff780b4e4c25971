"""Every registered query of the engine and its SQL counterpart.

Each module of queries registers with @query; the optional DuckDB SQL is what the same operator means in SQL.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for _name in ("mining", "evidence", "matching", "quality", "tables", "scalars", "sqlview", "streams", "filing", "records", "classification", "readers", "trees", "claims", "variants", "migration", "snapshots", "exports", "scans", "generic_reader"):
    importlib.import_module(f"factloom.plans.{_name}")
