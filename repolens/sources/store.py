"""Sink and source of an index: versioned Parquet tables and a pointer that is swapped last.

``commit`` writes every table into a new version folder and then the one-row ``current`` table, so
a reader sees a whole version or the one before.  ``load`` gives an empty table for a missing one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SCHEMAS


def commit(spark: SparkSession, base: str, tables: dict[str, DataFrame], at: int) -> str:
    """Write tables, ``meta`` last; returns the version."""
    version = f"{at:012d}-{uuid.uuid4().hex[:8]}"
    for name in sorted(tables, key=lambda n: n == "meta"):
        tables[name].write.mode("overwrite").parquet(f"{base}/versions/{version}/{name}")
    spark.createDataFrame([(version, at)], "version string, at long").coalesce(1).write.mode("append").parquet(f"{base}/current")
    return version


def current(spark: SparkSession, base: str) -> str | None:
    try:
        row = spark.read.schema("version string, at long").parquet(f"{base}/current").orderBy(F.desc("at"), F.desc("version")).first()
    except AnalysisException:
        return None
    return row.version if row else None


def load(spark: SparkSession, base: str, name: str, version: str | None = None) -> DataFrame:
    version = version or current(spark, base)
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{base}/versions/{version}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], SCHEMAS[name])


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def clear_pending(spark: SparkSession, path: str, done: DataFrame, to: str) -> DataFrame:
    """The queue without the processed files, written anew."""
    left = spark.read.schema(SCHEMAS["pending"]).json(path).where("f is not null").join(done.select("f").distinct(), "f", "left_anti")
    left.write.mode("overwrite").json(to)
    return spark.read.schema(SCHEMAS["pending"]).json(to)
