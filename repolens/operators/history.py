"""Change history: churn, last touch, recent changes, co-change.

``commits`` tables are (commit, file, ord): ``ord`` grows from the newest commit to older ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def churn(log: DataFrame, commit: str, file: str) -> DataFrame:
    """(file, n_commits): different commits that touch each file."""
    return log.groupBy(file).agg(F.countDistinct(commit).alias("n_commits"))


def last_touch(log: DataFrame, file: str, ts: str, newest_first: list[Column]) -> DataFrame:
    """(file, last_ts): the time of a file's first entry in log order, not its largest time."""
    return log.groupBy(file).agg(F.max_by(ts, F.struct(*newest_first)).alias("last_ts"))


def recent_changes(log: DataFrame, file: str, ts: str, order: str, days: int, limit: int = 50) -> DataFrame:
    """The first ``limit`` different files in log order, within ``days`` of the newest entry.  A
    file's first entry is a grouped maximum, and the limit a top-k: no global sort."""
    first = log.groupBy(file).agg(F.max_by(F.struct(ts, order), F.struct(F.col(ts), F.col(order))).alias("e")).select(file, f"e.{ts}", f"e.{order}")
    newest = log.agg(F.max(ts).alias("newest"))
    return first.crossJoin(F.broadcast(newest)).where(F.col(ts) >= F.col("newest") - F.make_interval(days=F.lit(days))).orderBy(F.desc(ts), F.desc(order), file).limit(limit).select(file, ts, order)


def co_change(log: DataFrame, commit: str, file: str, most: int = 30, least: int = 2, top: int = 10) -> DataFrame:
    """(file, partner, n, rank): files changed together in commits of 2 to ``most`` files, at least
    ``least`` times; each file's ``top`` partners.  A commit gives at most ``most`` squared pairs,
    and the counts are combined before they are shuffled."""
    own = log.select(commit, file).distinct()
    baskets = own.groupBy(commit).agg(F.collect_set(file).alias("files"), F.count("*").alias("k")).where(F.col("k").between(2, most))
    pairs = baskets.select(F.explode("files").alias(file), "files").select(file, F.explode("files").alias("partner")).where(F.col(file) != F.col("partner"))
    counted = pairs.groupBy(file, "partner").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy(file).orderBy(F.desc("n"), "partner")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
