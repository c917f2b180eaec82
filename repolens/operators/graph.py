"""Import graphs as edge tables (src, dst): degrees, reachability, shortest paths, call chains."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Different edges without self-loops."""
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: a checkpoint where the session has a folder for them (it survives a lost
    executor and cuts the lineage), else in memory and on local disk."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def centrality(e: DataFrame) -> DataFrame:
    """(node, importers): in-degree over different edges."""
    return e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("importers"))


def reverse_edges(e: DataFrame) -> DataFrame:
    """(node, importers, sources): sorted sources of each target."""
    return e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("importers"), F.sort_array(F.collect_set("src")).alias("sources"))


def fan(e: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) of every node."""
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def shortest_paths(e: DataFrame, start, goal, max_paths: int = 3, max_depth: int | None = None) -> DataFrame:
    """(path, hops, rank): up to ``max_paths`` simple paths of the least length, in path order.  A
    level at a time, from ``start``; a level keeps only nodes that no shorter path reached, so the
    walk stops at the first level that has the goal, or when a level is empty.  ``start == goal`` is
    the path of one node; ``max_depth`` is a limit where one is wanted."""
    spark = e.sparkSession
    kind, e = e.schema["src"].dataType.simpleString(), kept(e)  # every level joins the edges
    if start == goal:
        return spark.createDataFrame([([start], 0, 1)], f"path array<{kind}>, hops int, rank int")
    level = spark.createDataFrame([([start], start)], f"path array<{kind}>, node {kind}")
    seen = level.select("node")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = level.join(e, level.node == e.src).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"))
        level = kept(step.join(seen, "node", "left_anti").select("path", "node"))
        found = level.where(F.col("node") == F.lit(goal))
        if found.limit(1).count():
            hits = found.orderBy("path").limit(max_paths).select("path", F.lit(depth).alias("hops"))
            return hits.select("path", "hops", F.row_number().over(Window.partitionBy("hops").orderBy("path")).alias("rank"))
        if not level.limit(1).count():
            break
        seen = seen.union(level.select("node").distinct())
    return spark.createDataFrame([], f"path array<{kind}>, hops int, rank int")


def reachable(e: DataFrame, start, max_depth: int | None = None) -> DataFrame:
    """(node, hops): nodes reachable from ``start`` (itself at 0), by the least number of edges.  A
    level at a time; the walk ends when a level is empty, and every level is joined with the edges
    once."""
    kind, e = e.schema["src"].dataType.simpleString(), kept(e)  # every level joins the edges
    seen = e.sparkSession.createDataFrame([(start, 0)], f"node {kind}, hops int")
    level = seen.select("node")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        level = kept(level.join(e, level.node == e.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti"))
        if not level.limit(1).count():
            break
        seen = seen.union(level.withColumn("hops", F.lit(depth)))
    return seen


def call_chain(calls: DataFrame, start: str, depth: int = 3, most: int = 6) -> DataFrame:
    """(ord, depth, caller, callee) of a depth-first walk along ``calls`` (caller, callee, ord): the
    first ``most`` different callees of each node, nodes visited once.  Level joins gather the rows
    that the walk can reach (at most most ** depth); the driver orders those."""
    first = calls.groupBy("caller", "callee").agg(F.min("ord").alias("ord"))
    own = first.withColumn("rn", F.row_number().over(Window.partitionBy("caller").orderBy("ord", "callee"))).where(F.col("rn") <= most)
    level, rows = [start], {}
    for _ in range(depth):
        got = own.where(F.col("caller").isin(level)).orderBy("caller", "rn").collect()
        level = []
        for r in got:
            rows.setdefault(r.caller, []).append(r.callee)
            if r.callee not in rows:
                level.append(r.callee)
        level = sorted(set(level))
        if not level:
            break
    out, seen = [], {start}

    def visit(node: str, at: int) -> None:
        if at == depth:
            return
        for callee in rows.get(node, []):
            out.append((len(out), at + 1, node, callee))
            if callee not in seen:
                seen.add(callee)
                visit(callee, at + 1)

    visit(start, 0)
    return calls.sparkSession.createDataFrame(out, "ord int, depth int, caller string, callee string")
