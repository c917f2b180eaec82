"""Graph queries: nations that trade stand for files that import one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ._register import read, registry

QUERIES, ORACLES, query = registry()

_E = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts import their suppliers, whose keys are keys of parts as well: sparse over all rows."""
    return g.edges(read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("dep_edges", f"WITH {_E} SELECT * FROM e")
def dep_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query("centrality", f"WITH {_E} SELECT dst AS node, count(*) AS importers FROM e GROUP BY dst")
def centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.centrality(_edges(spark, sf_dir))


@query("reverse_edges", f"WITH {_E} SELECT dst AS node, count(*) AS importers, list_sort(list(src)) AS sources FROM e GROUP BY dst")
def reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.reverse_edges(_edges(spark, sf_dir))


@query("fan_in_out", f"WITH {_E} SELECT node, sum(i)::bigint AS fan_in, sum(o)::bigint AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node")
def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.fan(_edges(spark, sf_dir))


@query("shortest_paths", f"""WITH RECURSIVE {_E}, w(path, node, hops) AS (SELECT [3::bigint], 3::bigint, 0 UNION ALL SELECT list_append(path, e.dst), e.dst, hops + 1 FROM w JOIN e ON e.src = w.node WHERE hops < 7 AND NOT list_contains(path, e.dst) AND w.node <> 7)
 SELECT path, hops, row_number() OVER (ORDER BY path)::int AS rank FROM w WHERE node = 7 AND hops = (SELECT min(hops) FROM w WHERE node = 7) QUALIFY rank <= 3""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.shortest_paths(_edges(spark, sf_dir), 3, 7, 3)


@query("reachable_set", f"WITH RECURSIVE {_E}, w(node, hops) AS (SELECT 3::bigint, 0 UNION SELECT e.dst, hops + 1 FROM w JOIN e ON e.src = w.node WHERE hops < 40) SELECT node, min(hops)::int AS hops FROM w GROUP BY node")
def reachable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.reachable(_edges(spark, sf_dir), 3)


@query("call_chain", """WITH RECURSIVE c AS (SELECT (p_partkey - 2) // 8 + 1 AS caller, p_partkey AS callee, row_number() OVER (PARTITION BY (p_partkey - 2) // 8 ORDER BY p_partkey) AS rn FROM part WHERE p_partkey >= 2),
 w(path, depth, caller, callee) AS (SELECT [rn], 1, caller, callee FROM c WHERE caller = 1 AND rn <= 6 UNION ALL SELECT list_append(path, c.rn), depth + 1, c.caller, c.callee FROM w JOIN c ON c.caller = w.callee WHERE depth < 3 AND c.rn <= 6)
 SELECT (row_number() OVER (ORDER BY path) - 1)::int AS ord, depth, caller::varchar AS caller, callee::varchar AS callee FROM w""")
def call_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a tree: part k is called by part (k - 2) div 8 + 1, and a node shows six of its eight."""
    own = read(spark, sf_dir, "part").where("p_partkey >= 2")
    return g.call_chain(own.select(F.expr("cast((p_partkey - 2) div 8 + 1 AS string)").alias("caller"), F.col("p_partkey").cast("string").alias("callee"), F.col("p_partkey").alias("ord")), "1")
