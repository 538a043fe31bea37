"""Registered queries: name, Spark plan and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, longs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a plan under the operator's id, with its SQL; ``longs`` are columns that SQL counts in 64 bits."""

    def register(plan: Query) -> Query:
        QUERIES[name] = (lambda spark, sf_dir: plan(spark, sf_dir).withColumns({c: F.col(c).cast("bigint") for c in longs})) if longs else plan
        if sql:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
