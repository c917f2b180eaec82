"""Incremental maintenance: change detection, patching, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change): added, deleted or modified rows between two versions of a table."""
    o, n = old.select(key, F.col(version).alias("_o"), F.lit(1).alias("_in_old")), new.select(key, F.col(version).alias("_n"), F.lit(1).alias("_in_new"))
    both = o.join(n, key, "full")
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(~F.col("_o").eqNullSafe(F.col("_n")), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def mode(diff: DataFrame) -> str:
    """full if a row was added or deleted, incremental if some were modified, else noop."""
    r = diff.agg(F.count_if(F.col("change") != "modified").alias("a"), F.count("*").alias("n")).first()
    return "full" if r.a else "incremental" if r.n else "noop"


def patched(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of unchanged keys, and the fresh rows of the others."""
    return old.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def reusable(rows: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose stored result can be used again."""
    return rows.join(stored.select(*on).distinct(), on, "left_semi")


def to_compute(rows: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(stored.select(*on).distinct(), on, "left_anti")


def pending(queue: DataFrame, file: str, ts: str) -> DataFrame:
    """(file, since): different files of a queue and when each came first; torn rows are skipped."""
    return queue.where(F.col(file).isNotNull()).groupBy(file).agg(F.min(ts).alias("since"))


def survivors(queue: DataFrame, done: DataFrame, file: str) -> DataFrame:
    return queue.join(done.select(file).distinct(), file, "left_anti")


def evaluation(hits: DataFrame, group: str, rank: str = "rank", k: int = 8) -> DataFrame:
    """(group, n, hit1, hit3, hitk, mrr): overall (group null, is_total) and by group; ``rank`` is
    the first relevant position, null if none."""
    r = F.col(rank)
    agg = [F.count("*").alias("n"), F.count_if(r <= 1).alias("hit1"), F.count_if(r <= 3).alias("hit3"), F.count_if(r <= k).alias("hitk"), F.avg(F.when(r <= k, 1 / r).otherwise(0.0)).alias("mrr"), F.grouping(group).cast("int").alias("is_total")]
    return hits.rollup(group).agg(*agg)


def share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)
