"""Ranked retrieval: multi-field BM25F, semantic fusion, two-pass boosts, budgeted packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bm25_idf, generic_damp, round1

K1, B = 1.5, 0.75


def query_terms(terms: list[tuple[str, float]]) -> Column:
    """(token, weight) of a query as an array; a query is a handful of words."""
    return F.array(*[F.struct(F.lit(t).alias("token"), F.lit(float(q)).alias("q")) for t, q in terms])


def expand(terms: list[tuple[str, float]], aliases: dict[str, list[str]], weight: float = 0.5) -> list[tuple[str, float]]:
    """The terms and their aliases at ``weight`` times the term's; a token keeps its largest weight."""
    out = dict(terms)
    for t, q in terms:
        for a in aliases.get(t, []):
            out[a] = max(out.get(a, 0.0), q * weight)
    return list(out.items())


def bm25f(df: DataFrame, key: str, fields: list[tuple[Column, float]], terms: list[tuple[str, float]], path: Column | None = None) -> DataFrame:
    """(key, score, n_matched): sum over the query's terms of idf * damping * q * saturated field
    weights.  ``fields``: (array of different terms, boost).  A term in no field but part of
    ``path`` (four letters or more) counts 1.  The query stays in the expressions: one scan gives
    each row's hits, one aggregation the document frequencies (a row a term), and no row of the
    collection is shuffled before only matching rows are left."""
    # the fields are columns of their own first, so that each is computed once a row
    df = df.select(F.col(key).alias("key"), *[f.alias(f"f{i}") for i, (f, _) in enumerate(fields)], (path if path is not None else F.lit(None).cast("string")).alias("path"))
    fields, path = [(F.col(f"f{i}"), w) for i, (_, w) in enumerate(fields)], None if path is None else F.col("path")
    length = reduce(lambda a, b: a + b, [F.size(f).cast("double") * w for f, w in fields])
    tf = []
    for t, _ in terms:
        own = reduce(lambda a, b: a + b, [F.when(F.array_contains(f, t), F.lit(float(w))).otherwise(0.0) for f, w in fields])
        if path is not None and len(t) >= 4:
            own = F.when(own == 0, F.when(F.lower(path).contains(t), 1.0).otherwise(0.0)).otherwise(own)
        tf.append(own)
    # statistics and scores read the rows' few numbers from the cache: texts are tokenised once
    rows = df.select("key", length.alias("len"), F.array(*tf).alias("tf")).persist()
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), F.array(*[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms))]).alias("df"))
    n = F.col("n").cast("double")
    norm = K1 * (1 - B + B * F.col("len") / F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0))
    parts = [F.when(F.col("tf")[i] > 0, bm25_idf(F.col("df")[i].cast("double"), n) * generic_damp(F.col("df")[i].cast("double"), n) * q * F.col("tf")[i] * (K1 + 1) / (F.col("tf")[i] + norm)).otherwise(0.0) for i, (_, q) in enumerate(terms)]
    hit = rows.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))
    return hit.select(F.col("key").alias(key), reduce(lambda a, b: a + b, parts).alias("score"), F.size(F.filter("tf", lambda x: x > 0)).alias("n_matched"))


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in a total order, with rank: a top-k per task, then one of k rows a task."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def relative(df: DataFrame, score: str) -> DataFrame:
    """``relative``: 100 times the score over the largest one."""
    df = df.persist()  # matching rows only
    best = df.agg(F.max(score).alias("_best"))
    return df.crossJoin(F.broadcast(best)).withColumn("relative", F.col(score) * 100 / F.col("_best")).drop("_best")


def fuse(lexical: DataFrame, cosine: DataFrame, key: str, weight: float = 0.6, least_max: float = 0.15, spread: float = 0.03, admit: float = 0.6) -> DataFrame:
    """(key, lexical, semantic, score): lexical share of 100 plus weight * 80 * normalised cosine.
    ``lexical`` (key, score), ``cosine`` (key, cos).  Cosines count only where they say something
    (largest at least ``least_max``, and ``spread`` above the mean); rows without a lexical hit join
    from ``admit`` on."""
    stats = cosine.agg(F.greatest(F.max("cos"), F.lit(0.0)).alias("mx"), F.avg("cos").alias("mean"))
    norm = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cos") - F.col("mean")) / F.greatest(F.lit(0.01), F.col("mx") - F.col("mean"))))
    active = (F.col("mx") >= least_max) & (F.col("mx") - F.col("mean") >= spread)
    semantic = cosine.crossJoin(F.broadcast(stats)).select(key, F.when(active, norm).otherwise(0.0).alias("semantic"))
    both = relative(lexical, "score").select(key, F.col("relative").alias("lexical")).join(semantic, key, "full")
    both = both.select(key, F.coalesce("lexical", F.lit(0.0)).alias("lexical"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"))
    return both.where((F.col("lexical") > 0) | (F.col("semantic") >= admit)).withColumn("score", F.col("lexical") + round1(F.col("semantic") * weight * 80))


def budgeted(df: DataFrame, order: list[Column], cost: str, budget: int, most: int = 8) -> DataFrame:
    """The longest prefix of the first ``most`` rows whose costs add up to the budget at most."""
    w = Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.orderBy(*order).limit(most).withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def confidence(best: Column, matched: Column) -> Column:
    """high: 70 points and two different terms in the top three; medium: 40 points; else low."""
    return F.when((best >= 70) & (matched >= 2), "high").when(best >= 40, "medium").otherwise("low")
