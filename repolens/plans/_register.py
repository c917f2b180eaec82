"""Registration of a query with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def registry() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[name] = f
            if sql:
                oracles[name] = sql
            return f

        return add

    return queries, oracles, query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Send whole texts to Python in short batches: bounds the memory of a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
