"""Connected components of an edge table, without a hot task.

Labels start as the vertex itself; each round takes the smallest label among the neighbours (a
grouped minimum, combined before the shuffle) and then follows the label's own label (pointer
jumping), so chains shorten by powers of two.  Joins are on vertex or label, and a hot key is
split by the adaptive skew join.  Every round's labels are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for each vertex of ``edges`` (a, b): the smallest vertex reachable from v."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("l")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, labels.v == near.a, "left").select("v", F.col("l").alias("was"), F.least("l", F.coalesce("m", "l")).alias("l"))
        heads = step.select(F.col("v").alias("l"), F.col("l").alias("head"))
        new = stored(step.join(heads, "l", "left").select("v", "was", F.least("l", F.coalesce("head", "l")).alias("l")))
        changed = new.where("l <> was").limit(1).count()
        dropped(labels)
        labels = new.select("v", "l")
        if not changed:
            return labels.select("v", F.col("l").alias("component"))
