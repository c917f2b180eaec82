"""Vector operators: exact kNN, best chunk of a group, statistics, a hashing embedder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision over the shorter length, inside the JVM."""
    return F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(0.0), lambda s, x: s + F.coalesce(x["a"].cast("double") * x["b"].cast("double"), F.lit(0.0)))


def knn(df: DataFrame, key: str, vec: str, query: list[float], k: int) -> DataFrame:
    """(key, cos): the k rows nearest to one query vector; a top-k per task, never a full sort."""
    return cosines(df, key, vec, query).orderBy(F.desc("cos"), key).limit(k)


def group_best(df: DataFrame, group: str, key: str, vec: str, query: list[float]) -> DataFrame:
    """(group, best_key, best_cos): each group's nearest row, the smallest key of equal ones."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.select(group, key, dot(F.col(vec), q).alias("cos"))
    return scored.groupBy(group).agg(F.max_by(F.struct(key, "cos"), F.struct("cos", -F.col(key))).alias("b")).select(group, F.col(f"b.{key}").alias("best_key"), F.col("b.cos").alias("best_cos"))


def stats(df: DataFrame, key: str, group: str, vec: str) -> DataFrame:
    """One row: vectors, groups, dimension, and whether all vectors have it."""
    return df.agg(F.count("*").alias("n"), F.countDistinct(group).alias("n_groups"), F.min(F.size(vec)).alias("dim"), (F.min(F.size(vec)) == F.max(F.size(vec))).alias("consistent"))


_IN_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8))


def fnv1a(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """32-bit FNV-1a hashes of the stretches of bytes that begin at ``start``, the longest one first."""
    h = np.full(len(start), 2166136261, dtype=np.uint64)
    for k in range(int(length[0]) if len(length) else 0):
        m = int(np.searchsorted(-length, -k))  # those that go on
        h[:m] = (h[:m] ^ data[start[:m] + k]) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
    return h


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Counts of FNV-1a-hashed words, scaled to length 1; an offline stand-in for a model.  A text
    without words (or null) is the zero vector."""

    def embed(texts: pa.Array) -> pa.Array:
        blobs = [x.encode("utf-8", "surrogatepass") for x in texts.to_pylist()]
        data = np.frombuffer(b"".join(x + b" " for x in blobs), dtype=np.uint8)
        inside = np.r_[False, _IN_WORD[data]]
        start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        order = np.argsort(start - end, kind="stable")
        start, length = start[order], (end - start)[order]
        row = np.searchsorted(np.cumsum([len(x) + 1 for x in blobs]), start, side="right")
        cell = (fnv1a(data, start, length) % np.uint64(dim)).astype(np.int64)
        out = np.bincount(row * dim + cell, minlength=len(blobs) * dim).reshape(-1, dim).astype(float)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        out /= np.where(norm > 0, norm, 1)
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * dim, out.ravel())

    return F.arrow_udf(embed, "array<double>")(F.lower(F.coalesce(text, F.lit(""))))


def cosines(df: DataFrame, key: str, vec: str, query: list[float]) -> DataFrame:
    """(key, cos) of every row with one query vector, in no order."""
    return df.select(key, dot(F.col(vec), F.array(*[F.lit(float(x)) for x in query])).alias("cos"))
