"""Lookups: inverted index, symbol search, definitions, resolution cascades, neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inverted_index(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(token, ids, n): sorted different ids of each token of two characters or more.  Tokens are
    made distinct a row at a time, so a hot token's list is combined before the shuffle."""
    pairs = df.select(F.col(key).alias("id"), F.explode(F.array_distinct(tokens)).alias("token")).where(F.length("token") >= 2)
    return pairs.groupBy("token").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.countDistinct("id").alias("n"))


def symbol_search(df: DataFrame, name: str, order: list[str], query: str, where: Column | None = None, limit: int = 20) -> DataFrame:
    """Rows whose name holds the query (any case), exact names first."""
    low = F.lower(name)
    hit = df.where(low.contains(query.lower()) & (where if where is not None else F.lit(True)))
    return hit.orderBy((low != query.lower()).cast("int"), *order).limit(limit)


def pick(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def resolve(specs: DataFrame, key: str, candidates: list[Column], targets: DataFrame, target: str) -> DataFrame:
    """(key, target, priority): the first candidate of each row that exists among the targets."""
    tried = specs.select(key, F.posexplode(F.array(*candidates)).alias("priority", target)).where(F.col(target).isNotNull())
    hit = tried.join(targets.select(target).distinct(), target)
    return hit.groupBy(key).agg(F.min_by(target, "priority").alias(target), F.min("priority").alias("priority"))


def longest_prefix(df: DataFrame, key: str, path: Column, prefixes: DataFrame, prefix: str) -> DataFrame:
    """(key, prefix): the longest prefix (of whole path parts) of each row's path, or null.  Each
    path is blown up into its own prefixes, which makes the match an equi-join."""
    parts = F.split(path, "/")
    own = df.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias(prefix))
    hit = own.join(prefixes.select(prefix).distinct(), prefix).groupBy(key).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return df.select(key).join(hit, key, "left")


def first_others(df: DataFrame, by: list[str], other: str, most: int) -> DataFrame:
    """The rows of each group's ``most`` smallest different values of ``other``."""
    return df.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(other))).where(F.col("_rank") <= most).drop("_rank")


def neighbourhood(groups: dict[str, DataFrame], key: str, other: str, most: int = 10) -> DataFrame:
    """(key, group, other, pos): each group's first ``most`` related rows, in ascending order."""
    own = [d.select(key, F.lit(g).alias("group"), other).distinct() for g, d in groups.items()]
    w = Window.partitionBy(key, "group").orderBy(other)
    return reduce(DataFrame.union, own).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def roles(uses: DataFrame, definitions: DataFrame, calls: DataFrame, on: list[str]) -> DataFrame:
    """Uses with ``role``: def at a definition's place, call at a call's, else use."""
    d = definitions.select(*on).distinct().withColumn("_d", F.lit(1))
    c = calls.select(*on).distinct().withColumn("_c", F.lit(1))
    return uses.join(d, on, "left").join(c, on, "left").withColumn("role", F.when(F.col("_d") == 1, "def").when(F.col("_c") == 1, "call").otherwise("use")).drop("_d", "_c")


def test_links(files: DataFrame, key: str, stem: Column, is_test: Column) -> DataFrame:
    """(source, test): tests of each source by equal stem."""
    own = files.select(F.col(key), stem.alias("stem"), is_test.alias("is_test"))
    return own.where("not is_test").select(F.col(key).alias("source"), "stem").join(own.where("is_test").select(F.col(key).alias("test"), "stem"), "stem").select("source", "test")
