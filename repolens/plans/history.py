"""Change-history queries: orders stand for commits, parts and suppliers for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as h
from ..operators import maintenance as m
from ._register import read, registry

QUERIES, ORACLES, query = registry()


@query("churn", "SELECT l_partkey, count(DISTINCT l_orderkey) AS n_commits FROM lineitem GROUP BY l_partkey")
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.churn(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "o_orderkey", "o_orderdate")


@query("last_touch", "SELECT l_partkey, arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS last_ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
def last_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.last_touch(_log(spark, sf_dir), "l_partkey", "o_orderdate", [F.col("o_orderdate"), F.col("o_orderkey")])


@query("recent_changes", """WITH f AS (SELECT l_partkey, max(struct_pack(d := o_orderdate, k := o_orderkey)) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey)
 SELECT l_partkey, e.d AS o_orderdate, e.k AS o_orderkey FROM f WHERE e.d >= (SELECT max(o_orderdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) - INTERVAL 30 DAY ORDER BY e.d DESC, e.k DESC, l_partkey LIMIT 50""")
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.recent_changes(_log(spark, sf_dir), "l_partkey", "o_orderdate", "o_orderkey", 30)


_CO = """WITH b AS (SELECT DISTINCT l_orderkey, {k} AS f FROM lineitem), s AS (SELECT l_orderkey FROM b GROUP BY l_orderkey HAVING count(*) BETWEEN 2 AND 30),
 p AS (SELECT x.f AS {k}, y.f AS partner, count(*) AS n FROM b x JOIN b y USING (l_orderkey) JOIN s USING (l_orderkey) WHERE x.f <> y.f GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT {k}, partner, n, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, partner)::int AS rank FROM p QUALIFY rank <= 10"""


@query("cochange_top10", _CO.format(k="l_partkey"))
def cochange_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.co_change(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("cochange_suppliers", _CO.format(k="l_suppkey"))
def cochange_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.co_change(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


_OLD = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)"


@query("incremental_diff", f"""SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change
 FROM {_OLD} o FULL JOIN (SELECT doc_id, text FROM documents WHERE doc_id % 13 <> 5) n ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.text IS DISTINCT FROM n.text""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older version lacks some documents and has other texts of some; versions are compared by
    a hash of the text, so texts aren't shuffled."""
    docs = read(spark, sf_dir, "documents")
    old = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("v"))
    return m.changes(old, docs.where("doc_id % 13 <> 5").select("doc_id", F.sha2("text", 256).alias("v")), "doc_id", "v")


@query("patched_rows", "SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents")
def patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    old = docs.select("doc_id", F.md5("text").alias("h"))
    fresh = docs.where("doc_id % 7 = 0").select("doc_id", F.md5(F.concat("text", F.lit("!"))).alias("h"))
    return m.patched(old, fresh, "doc_id")


@query("vector_reuse", "SELECT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS reused FROM documents")
def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, emb = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return m.reusable(docs, emb, ["doc_id"]).withColumn("reused", F.lit(True)).union(m.to_compute(docs, emb, ["doc_id"]).withColumn("reused", F.lit(False)))


@query("pending_queue", "WITH q AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS f, ts, event_type FROM events WHERE user_id IS NOT NULL) SELECT f, min(ts) AS since FROM q WHERE f NOT IN (SELECT f FROM q WHERE event_type = 'purchase') GROUP BY f")
def pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users, queued at their first event and done with a purchase."""
    ev = read(spark, sf_dir, "events").withColumn("f", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")))
    return m.survivors(m.pending(ev, "f", "ts"), ev.where("event_type = 'purchase'"), "f")
