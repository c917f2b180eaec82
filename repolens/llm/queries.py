"""Queries opN_<name> of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table


def op1_ann_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, k=20)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_store, write_store

    return read_store(write_store(table(spark, sf_dir, "documents"), end_id=0))


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), end_id=1)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import passages

    return passages(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language

    return language(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nn_descent import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_nbest import encode_nbest

    return encode_nbest(table(spark, sf_dir, "documents"), n=4, ids=False, decoded=True)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import language_model

    return language_model(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ann_kmeans_tree, op2_token_store, op3_retrieval_packing, op4_substring_dedup, op5_language, op6_nn_descent, op7_toxicity, op8_sentencepiece_nbest, op9_language_model, op10_jaccard_join)}
ORACLES: dict[str, str] = {}
