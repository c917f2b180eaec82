"""Lookup queries: parts stand for symbols and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import split_identifier
from ..operators import lookup as k
from ._register import read, registry

QUERIES, ORACLES, query = registry()


@query("inverted_index", """WITH x AS (SELECT p_partkey, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: length(t) >= 2))) AS token FROM part)
 SELECT token, list_sort(list(DISTINCT p_partkey)) AS ids, count(DISTINCT p_partkey) AS n FROM x GROUP BY token""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.inverted_index(read(spark, sf_dir, "part"), "p_partkey", split_identifier(F.col("p_name")))


@query("symbol_search", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'widget') AND p_size >= 5 ORDER BY (lower(p_name) <> 'widget')::int, p_name, p_partkey LIMIT 20")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.symbol_search(read(spark, sf_dir, "part"), "p_name", ["p_name", "p_partkey"], "widget", F.col("p_size") >= 5).select("p_partkey", "p_name", "p_brand")


@query("definition_pick", "SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 25) DESC, p_size, p_partkey) = 1")
def definition_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.pick(read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], [(F.col("p_size") > 25).desc(), F.col("p_size"), F.col("p_partkey")])


@query("resolve_cascade", """WITH t AS (SELECT r_name AS target FROM region UNION SELECT n_name FROM nation), c AS (SELECT n_nationkey, 0 AS priority, n_name || '.ts' AS target FROM nation UNION ALL SELECT n_nationkey, 1, CASE WHEN n_nationkey % 2 = 0 THEN n_name END FROM nation UNION ALL SELECT n_nationkey, 2, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
 SELECT n_nationkey, arg_min(target, priority) AS target, min(priority)::int AS priority FROM c JOIN t USING (target) GROUP BY n_nationkey""")
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    specs = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    targets = region.select(F.col("r_name").alias("target")).union(nation.select("n_name"))
    return k.resolve(specs, "n_nationkey", [F.concat("n_name", F.lit(".ts")), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.col("r_name")], targets, "target")


@query("longest_prefix_assign", """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), x AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix FROM p UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p WHERE page_id % 3 = 0 AND contains(path, '/'))
 SELECT page_id, arg_max(prefix, length(prefix)) AS prefix FROM p LEFT JOIN x ON path = prefix OR starts_with(path, prefix || '/') GROUP BY page_id""")
def longest_prefix_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    one = F.substring_index("path", "/", 1)
    x = p.select(one.alias("prefix")).union(p.where("page_id % 3 = 0 and contains(path, '/')").select(F.substring_index("path", "/", 2)))
    return k.longest_prefix(p, "page_id", F.col("path"), x, "prefix")




@query("related_neighbourhood", """WITH s AS (SELECT * FROM part WHERE p_size = 7), g AS (
 SELECT s.p_partkey, 'brand' AS "group", o.p_partkey AS other FROM s JOIN part o ON s.p_brand = o.p_brand AND s.p_size = o.p_size AND s.p_partkey <> o.p_partkey
 UNION SELECT s.p_partkey, 'type', o.p_partkey FROM s JOIN part o ON s.p_type = o.p_type AND s.p_brand <> o.p_brand AND o.p_size = 7
 UNION SELECT x.l_partkey, 'ordered', y.l_partkey FROM lineitem x JOIN s ON s.p_partkey = x.l_partkey JOIN lineitem y USING (l_orderkey) WHERE x.l_partkey <> y.l_partkey)
 SELECT *, row_number() OVER (PARTITION BY p_partkey, "group" ORDER BY other)::int AS pos FROM g QUALIFY pos <= 10""")
def related_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For parts of one size: same brand and size, same type of another brand, ordered together."""
    part, item = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    s = part.where("p_size = 7")
    o = s.select(F.col("p_partkey").alias("other"), F.col("p_brand").alias("ob"), F.col("p_type").alias("ot")).where("other is not null").distinct()
    mates = k.first_others(o.select("ob", "other").distinct(), ["ob"], "other", 11)  # one may be the part itself
    brand = s.join(mates, (F.col("p_brand") == F.col("ob")) & (F.col("p_partkey") != F.col("other"))).select("p_partkey", "other")
    like = k.first_others(k.first_others(o, ["ot", "ob"], "other", 10), ["ot"], "other", 20)  # ten at most have the part's brand alone
    kind = s.join(like, (F.col("p_type") == F.col("ot")) & (F.col("p_brand") != F.col("ob"))).select("p_partkey", "other")
    x = item.join(s.select(F.col("p_partkey").alias("l_partkey")), "l_partkey").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    ordered = x.join(item.select("l_orderkey", F.col("l_partkey").alias("other")), "l_orderkey").where("p_partkey <> other").select("p_partkey", "other")
    return k.neighbourhood({"brand": brand, "type": kind, "ordered": ordered}, "p_partkey", "other")


@query("find_tests", """WITH f AS (SELECT p_partkey, p_name || '|' || p_brand AS stem, p_size % 5 = 0 AS is_test FROM part) SELECT a.p_partkey AS source, b.p_partkey AS test FROM f a JOIN f b USING (stem) WHERE NOT a.is_test AND b.is_test""")
def find_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.test_links(read(spark, sf_dir, "part"), "p_partkey", F.concat("p_name", F.lit("|"), "p_brand"), F.col("p_size") % 5 == 0)


_WORDS = "w AS (SELECT conv_id, turn, role, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t: length(t) >= 6))) AS name FROM conversations)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 6))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.explode(tok).alias("name"))


@query("references_roles", f"""WITH {_WORDS}, d AS (SELECT conv_id, name, min(turn) AS turn FROM w GROUP BY conv_id, name), c AS (SELECT DISTINCT conv_id, name, turn FROM w WHERE role = 'assistant')
 SELECT w.conv_id, w.turn, w.name, CASE WHEN d.name IS NOT NULL THEN 'def' WHEN c.name IS NOT NULL THEN 'call' ELSE 'use' END AS role FROM w LEFT JOIN d ON (w.conv_id, w.name, w.turn) = (d.conv_id, d.name, d.turn) LEFT JOIN c ON (w.conv_id, w.name, w.turn) = (c.conv_id, c.name, c.turn)""")
def references_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir)
    d = w.groupBy("conv_id", "name").agg(F.min("turn").alias("turn"))
    return k.roles(w.drop("role"), d, w.where("role = 'assistant'"), ["conv_id", "name", "turn"]).select("conv_id", "turn", "name", "role")


@query("callee_resolution", f"""WITH {_WORDS}, d AS (SELECT name, conv_id AS place, min(turn) AS line FROM w WHERE role = 'user' GROUP BY name, conv_id), u AS (SELECT DISTINCT conv_id, name FROM w WHERE role = 'assistant'),
 r AS (SELECT u.conv_id, u.name, d.place, CASE WHEN d.place = u.conv_id THEN 0 WHEN d.place = u.conv_id - 1 THEN 1 WHEN d.place IS NOT NULL THEN 2 ELSE 3 END AS p FROM u LEFT JOIN d USING (name))
 SELECT conv_id, name, place AS target, ['same-file','import','heuristic','external'][p + 1] AS via FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, name ORDER BY p, place) = 1""")
def callee_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition in the caller's own file, then in the one it imports, then the first anywhere.
    Each step is an equi-join with one row a name, so a common name isn't joined pairwise."""
    w = _words(spark, sf_dir)
    d = w.where("role = 'user'").select("name", F.col("conv_id").alias("target")).distinct()
    u = w.where("role = 'assistant'").select("conv_id", "name").distinct()
    own = d.select("name", F.col("target").alias("conv_id"), F.lit(True).alias("own"))
    near = d.select("name", (F.col("target") + 1).alias("conv_id"), F.lit(True).alias("near"))
    anywhere = d.groupBy("name").agg(F.min("target").alias("first"))
    r = u.join(own, ["conv_id", "name"], "left").join(near, ["conv_id", "name"], "left").join(anywhere, "name", "left")
    via = F.when(F.col("own"), "same-file").when(F.col("near"), "import").when(F.col("first").isNotNull(), "heuristic").otherwise("external")
    target = F.when(F.col("own"), F.col("conv_id")).when(F.col("near"), F.col("conv_id") - 1).otherwise(F.col("first"))
    return r.select("conv_id", "name", target.alias("target"), via.alias("via"))


@query("commands_by_kind", "SELECT event_type AS kind, count(*) AS n, list_sort(list(DISTINCT user_id))[1:15] AS first_users FROM events GROUP BY event_type")
def commands_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a kind and its first 15 users: different pairs are ranked, so no list is longer."""
    ev = read(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "user_id")
    pairs = ev.groupBy("kind", "user_id").agg(F.count("*").alias("n"))
    first = pairs.where("user_id is not null").withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy("user_id"))).where("rn <= 15").groupBy("kind").agg(F.sort_array(F.collect_list("user_id")).alias("first_users"))
    return pairs.groupBy("kind").agg(F.sum("n").alias("n")).join(first, "kind", "left").select("kind", "n", F.coalesce("first_users", F.array().cast("array<bigint>")).alias("first_users"))
