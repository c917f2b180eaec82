"""Ranked retrieval and vector queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, bm25_idf, generic_damp, round1, tokenize
from ..operators import maintenance, ranking, vectors
from ._register import read, registry, short_batches

QUERIES, ORACLES, query = registry()

TERMS = [("the", 1.0), ("tion", 1.0), ("src3", 2.0), ("enont", 1.0), ("with", 1.0)]
_NOISE = "('id','to','the','and','for','with','from','that','this','into','der','die','das','les','des','une','los','las','que')"
_TOKENS = f"list_filter(regexp_split_to_array(lower(translate(coalesce(text,''),'{ACCENTED}','{PLAIN}')),'[^a-z0-9]+'), lambda x: length(x) >= 2 and x not in {_NOISE})"
_FIRST = f"list_filter(regexp_split_to_array(lower(translate(split_part(coalesce(text,''),chr(10),1),'{ACCENTED}','{PLAIN}')),'[^a-z0-9]+'), lambda x: length(x) >= 2 and x not in {_NOISE})"
_FIELDS = f"""f AS (SELECT doc_id, lower(coalesce(source,'')) src, lower(coalesce(lang,'')) lng,
   list_distinct({_TOKENS}) tok, list_distinct({_FIRST}) head FROM documents)"""
_BM25 = f"""WITH q(t, w) AS (VALUES {', '.join(f"('{t}', {w})" for t, w in TERMS)}), {_FIELDS},
 d AS (SELECT *, 5.0*(src <> '')::int + 3.0*(lng <> '')::int + 2.0*len(tok) + 1.5*len(head) AS dl FROM f),
 st AS (SELECT count(*)::double n, avg(dl) a FROM d),
 hit AS (SELECT doc_id, t, w, dl, 5.0*(src = t)::int + 3.0*(lng = t)::int + 2.0*list_contains(tok, t)::int + 1.5*list_contains(head, t)::int AS tf FROM d, q),
 df AS (SELECT t, count(*)::double df FROM hit WHERE tf > 0 GROUP BY t),
 scored AS (SELECT doc_id, sum(ln(1+(n-df+0.5)/(df+0.5)) * CASE WHEN df/n <= 0.08 THEN 1.0 WHEN df/n >= 0.30 THEN 0.12 ELSE 1.0-(df/n-0.08)/0.22*0.88 END * w * tf*2.5/(tf+1.5*(0.25+0.75*dl/a))) AS score,
   count(*) AS n_matched FROM hit JOIN df USING (t), st WHERE tf > 0 GROUP BY doc_id)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    one = lambda c: F.filter(F.array(F.lower(F.coalesce(F.col(c), F.lit("")))), lambda x: x != "")
    fields = [(one("source"), 5.0), (one("lang"), 3.0), (F.array_distinct(tokenize(F.col("text"))), 2.0), (F.array_distinct(tokenize(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))), 1.5)]
    return ranking.bm25f(docs, "doc_id", fields, TERMS)


@query("bm25f_topk", f"""{_BM25}, r AS (SELECT doc_id, score, n_matched, score*100/max(score) OVER () AS relative FROM scored)
 SELECT doc_id, round(relative, 6) AS relative, n_matched::int AS n_matched, row_number() OVER (ORDER BY round(relative, 6) DESC, doc_id)::int AS rank FROM r QUALIFY rank <= 40""")
def bm25f_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranking.relative(_scored(spark, sf_dir), "score").select("doc_id", F.round("relative", 6).alias("relative"), "n_matched")
    return ranking.top(r, [F.desc("relative"), F.col("doc_id")], 40)


@query("doc_frequency", f"""WITH {_FIELDS}, n AS (SELECT count(*)::double n FROM f), x AS (SELECT unnest(tok) token FROM f), c AS (SELECT token, count(*) df FROM x GROUP BY token)
 SELECT token, df, round(ln(1+(n-df+0.5)/(df+0.5)), 9) AS idf, round(CASE WHEN df/n <= 0.08 THEN 1.0 WHEN df/n >= 0.30 THEN 0.12 ELSE 1.0-(df/n-0.08)/0.22*0.88 END, 9) AS damp FROM c, n WHERE df >= 3""")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").cast("double").alias("n"))
    df = docs.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df >= 3")
    d = F.col("df").cast("double")
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(bm25_idf(d, F.col("n")), 9).alias("idf"), F.round(generic_damp(d, F.col("n")), 9).alias("damp"))


@query("alias_expansion", """WITH q(t, w) AS (VALUES ('auth', 1.0), ('connexion', 2.0), ('donnees', 1.0), ('database', 0.25)), a(t, x) AS (VALUES ('auth','authentication'), ('authentication','auth'), ('connexion','connection'), ('donnees','database'))
 SELECT token, max(q) AS q FROM (SELECT t AS token, w::double AS q FROM q UNION ALL SELECT x, (w*0.5)::double FROM q JOIN a USING (t)) GROUP BY token""")
def alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = {"auth": ["authentication"], "authentication": ["auth"], "connexion": ["connection"], "donnees": ["database"]}
    return spark.createDataFrame(ranking.expand([("auth", 1.0), ("connexion", 2.0), ("donnees", 1.0), ("database", 0.25)], aliases), "token string, q double")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


_COS = "list_inner_product(embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 0))"


@query("vector_knn", f"SELECT vec_id, round({_COS}, 6) AS cos FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 12")
def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.knn(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 12).select("vec_id", F.round("cos", 6).alias("cos"))


@query("vector_group_max", f"SELECT label, vec_id AS best_key, round(cos, 6) AS best_cos FROM (SELECT label, vec_id, {_COS} AS cos FROM embeddings) QUALIFY row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) = 1")
def vector_group_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.group_best(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", _query_vector(spark, sf_dir)).withColumn("best_cos", F.round("best_cos", 6))


@query("vector_stats", "SELECT count(*) AS n, count(DISTINCT label) AS n_groups, min(len(embedding))::int AS dim, min(len(embedding)) = max(len(embedding)) AS consistent FROM embeddings")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.stats(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


_FUSED = f"""{_BM25}, lex AS (SELECT doc_id, score*100/max(score) OVER () AS lexical FROM scored),
 cosines AS (SELECT vec_id AS doc_id, {_COS} AS cos FROM embeddings), cs AS (SELECT greatest(max(cos), 0) mx, avg(cos) mean FROM cosines),
 sem AS (SELECT doc_id, CASE WHEN mx >= 0.15 AND mx - mean >= 0.03 THEN greatest(0, least(1, (cos-mean)/greatest(0.01, mx-mean))) ELSE 0 END AS semantic FROM cosines, cs),
 fused AS (SELECT coalesce(lex.doc_id, sem.doc_id) AS doc_id, coalesce(lexical, 0) AS lexical, coalesce(semantic, 0) AS semantic FROM lex FULL JOIN sem ON lex.doc_id = sem.doc_id)"""


@query("semantic_norm", f"""WITH cosines AS (SELECT vec_id, {_COS} AS cos FROM embeddings), cs AS (SELECT greatest(max(cos), 0) mx, avg(cos) mean FROM cosines)
 SELECT vec_id, round(greatest(0, least(1, (cos-mean)/greatest(0.01, mx-mean))), 6) AS semantic FROM cosines, cs""")
def semantic_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    cos = vectors.cosines(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir))
    st = cos.agg(F.greatest(F.max("cos"), F.lit(0.0)).alias("mx"), F.avg("cos").alias("mean"))
    return cos.crossJoin(F.broadcast(st)).select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cos") - F.col("mean")) / F.greatest(F.lit(0.01), F.col("mx") - F.col("mean")))), 6).alias("semantic"))


@query("hybrid_rank", f"""{_FUSED}, s AS (SELECT doc_id, lexical, semantic, round(lexical + floor(semantic*0.6*80*10+0.5)/10, 6) AS score FROM fused WHERE lexical > 0 OR semantic >= 0.6)
 SELECT doc_id, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, score, row_number() OVER (ORDER BY score DESC, doc_id)::int AS rank FROM s WHERE score >= 25 QUALIFY rank <= 40""")
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)])
    cos = emb.select("doc_id", vectors.dot(F.col("embedding"), q).alias("cos"))
    fused = ranking.fuse(_scored(spark, sf_dir), cos, "doc_id").withColumn("score", F.round("score", 6)).where("score >= 25")
    return ranking.top(fused, [F.desc("score"), F.col("doc_id")], 40).select("doc_id", F.round("lexical", 6).alias("lexical"), F.round("semantic", 6).alias("semantic"), "score", "rank")


@query("budget_prefix", f"""{_BM25}, r AS (SELECT doc_id, round(score*100/max(score) OVER (), 6) AS relative, ceil(length(text)/4.0)::bigint AS cost FROM scored JOIN documents USING (doc_id)),
 t AS (SELECT * FROM r ORDER BY relative DESC, doc_id LIMIT 8) SELECT doc_id, cost, sum(cost) OVER (ORDER BY relative DESC, doc_id ROWS UNBOUNDED PRECEDING)::bigint AS used FROM t QUALIFY used <= 6000""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranking.relative(_scored(spark, sf_dir), "score").withColumn("relative", F.round("relative", 6))
    top = r.orderBy(F.desc("relative"), "doc_id").limit(8)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.ceil(F.length("text") / 4).cast("long").alias("cost"))
    return ranking.budgeted(docs.join(F.broadcast(top), "doc_id"), [F.desc("relative"), F.col("doc_id")], "cost", 6000).select("doc_id", "cost", "used")


@query("confidence_label", f"""{_BM25}, t AS (SELECT * FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 3)
 SELECT round(max(score), 6) AS best, max(n_matched)::int AS matched, CASE WHEN max(score)*10 >= 70 AND max(n_matched) >= 2 THEN 'high' WHEN max(score)*10 >= 40 THEN 'medium' ELSE 'low' END AS confidence FROM t""")
def confidence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _scored(spark, sf_dir).orderBy(F.desc(F.round("score", 6)), "doc_id").limit(3)
    return t.agg(F.round(F.max("score"), 6).alias("best"), F.max("n_matched").alias("matched"), ranking.confidence(F.max("score") * 10, F.max("n_matched")).alias("confidence"))


@query("two_pass_boost", """WITH b AS (SELECT p_partkey, p_brand, p_name, round(p_retailprice*100/max(p_retailprice) OVER (), 6) AS base FROM part),
 t AS (SELECT * FROM b ORDER BY base DESC, length(p_name), p_partkey LIMIT 5), one AS (SELECT p_brand FROM b ORDER BY base DESC, length(p_name), p_partkey LIMIT 1),
 basket AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), partner AS (SELECT DISTINCT x.l_partkey AS p_partkey FROM basket x JOIN basket y USING (l_orderkey) WHERE y.l_partkey IN (SELECT p_partkey FROM t) AND x.l_partkey <> y.l_partkey),
 s AS (SELECT b.p_partkey, base, floor((base + CASE WHEN b.p_partkey IN (SELECT p_partkey FROM partner) THEN 6 ELSE 0 END + CASE WHEN b.p_brand = (SELECT p_brand FROM one) AND b.p_partkey <> (SELECT p_partkey FROM t ORDER BY base DESC, length(p_name), p_partkey LIMIT 1) THEN 3 ELSE 0 END)*10+0.5)/10 AS score, length(p_name) AS l FROM b)
 SELECT p_partkey, base, score, row_number() OVER (ORDER BY score DESC, l, p_partkey)::int AS rank FROM s WHERE score >= 25 QUALIFY rank <= 40""")
def two_pass_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, item = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    best = part.agg(F.max("p_retailprice").alias("mx"))
    base = part.crossJoin(F.broadcast(best)).select("p_partkey", "p_brand", F.length("p_name").alias("l"), F.round(F.col("p_retailprice") * 100 / F.col("mx"), 6).alias("base"))
    top = ranking.top(base, [F.desc("base"), F.col("l"), F.col("p_partkey")], 5)
    orders = item.join(F.broadcast(top.select(F.col("p_partkey").alias("l_partkey"))), "l_partkey").select("l_orderkey", F.col("l_partkey").alias("lead")).distinct()
    partner = item.select("l_orderkey", "l_partkey").join(orders, "l_orderkey").where("l_partkey <> lead").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("partner", F.lit(6.0))
    one = top.where("rank = 1").select(F.col("p_brand").alias("b1"), F.col("p_partkey").alias("k1"))
    s = base.join(partner, "p_partkey", "left").crossJoin(F.broadcast(one))
    s = s.withColumn("score", round1(F.col("base") + F.coalesce("partner", F.lit(0.0)) + F.when((F.col("p_brand") == F.col("b1")) & (F.col("p_partkey") != F.col("k1")), 3.0).otherwise(0.0)))
    return ranking.top(s.where("score >= 25"), [F.desc("score"), F.col("l"), F.col("p_partkey")], 40).select("p_partkey", "base", "score", "rank")


@query("eval_hit_mrr", """WITH q AS (SELECT vec_id AS qid, label AS ql, embedding::double[] AS qe FROM embeddings WHERE vec_id < 20),
 s AS (SELECT qid, ql, label, row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(qe, embedding::double[]) DESC, vec_id) AS r FROM q, embeddings WHERE vec_id <> qid),
 h AS (SELECT qid, ql AS grp, min(CASE WHEN r <= 8 AND label = ql THEN r END) AS rank FROM s GROUP BY qid, ql)
 SELECT grp, count(*) AS n, count(*) FILTER (rank <= 1) AS hit1, count(*) FILTER (rank <= 3) AS hit3, count(*) FILTER (rank <= 8) AS hitk, avg(CASE WHEN rank <= 8 THEN 1.0/rank ELSE 0 END) AS mrr, grouping(grp)::int AS is_total FROM h GROUP BY ROLLUP (grp)""")
def eval_hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    emb = read(spark, sf_dir, "embeddings")
    q = emb.where("vec_id < 20").select(F.col("vec_id").alias("qid"), F.col("label").alias("grp"), F.col("embedding").alias("qe"))  # twenty queries
    s = emb.crossJoin(F.broadcast(q)).where("vec_id <> qid").withColumn("cos", vectors.dot(F.col("qe"), F.col("embedding")))
    near = s.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "vec_id"))).where("r <= 8")
    hits = q.select("qid", "grp").join(near.where("label = grp").groupBy("qid").agg(F.min("r").alias("rank")), "qid", "left")
    return maintenance.evaluation(hits, "grp")


_FNV = "list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split(w, ''), lambda x: ascii(x)::ubigint)), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


@query("stub_embedding", f"""WITH h AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: {_FNV} % 32) AS h FROM documents),
 c AS (SELECT doc_id, list_transform(range(32), lambda i: len(list_filter(h, lambda x: x = i))::double) AS c FROM h)
 SELECT doc_id, list_transform(c, lambda x: CASE WHEN list_sum(c) > 0 THEN x / sqrt(list_sum(list_transform(c, lambda y: y * y))) ELSE x END) AS embedding FROM c""")
def stub_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return read(spark, sf_dir, "documents").select("doc_id", vectors.hash_embedding(F.col("text"), 32).alias("embedding"))
