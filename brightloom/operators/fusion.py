"""Ranked lists: merging tiers, reciprocal rank fusion, normalising, reranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def keep_first(lists: list[DataFrame]) -> DataFrame:
    """query_id, chunk_id, score and tier of the first list, in the order given, that holds a chunk; within a list the better rank."""
    rows = reduce(DataFrame.unionByName, (x.select("query_id", "chunk_id", "score", "rank", F.lit(i).alias("tier")) for i, x in enumerate(lists)))
    first = rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("tier", "rank", "score")).alias("x"))
    return first.select("query_id", "chunk_id", "x.score", "x.tier", F.col("x.rank").alias("tier_rank"))


def cut_merged(merged: DataFrame, k: int) -> DataFrame:
    """The k best of merged tiers: by score, then tier, rank and id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "tier", "tier_rank", "chunk_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(lists: list[tuple[DataFrame, float]], k: int = 60, digits: int = 9) -> DataFrame:
    """query_id, chunk_id, score and rank by the sum over lists of weight / (60 + rank)."""
    parts = [x.select("query_id", "chunk_id", (F.lit(float(w)) / (RRF_K + F.col("rank"))).alias("s")) for x, w in lists]
    scores = reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), digits).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def min_max(rows: DataFrame, score: str = "score", group: str = "query_id") -> DataFrame:
    """Scores spread to 0..1 within each group; where all are equal, 1."""
    bounds = rows.groupBy(group).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    return rows.join(bounds, group).withColumn(score, F.when(spread == 0, 1.0).otherwise((F.col(score) - F.col("_lo")) / F.when(spread != 0, spread))).drop("_lo", "_hi")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def score_pairs(query: Column, content: Column, model: Callable[[list[tuple[str, str]]], list[float]]) -> Column:
    """Raw relevance by an injected pair model over the first 512 characters."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(model(list(zip(queries, texts, strict=True))), dtype="float64")

    return run(query, F.substring(content, 1, 512))


def rerank(candidates: DataFrame, k: int = 6, raw: str | None = "raw") -> DataFrame:
    """The k best of ``candidates`` (query_id, chunk_id, score, rank, exact and a raw model score) by final_score.

    Exact hits score 1 and stand first in their order; others get 0.7 sigmoid(raw) + 0.3 of the score spread to 0..1. Without a model
    (``raw`` None) the score itself is final.
    """
    rows = min_max(candidates.withColumn("norm", F.col("score")), "norm")
    final = F.when(F.col("exact"), 1.0).otherwise(F.col("score") if raw is None else F.round(0.7 * sigmoid(F.col(raw)) + 0.3 * F.col("norm"), 6))
    rows = rows.withColumn("final_score", final)
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.when(F.col("exact"), F.col("rank")), F.desc("final_score"), "rank", "chunk_id")
    return rows.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k).select("query_id", "chunk_id", "score", "final_score", "final_rank")


def multi_query(results: DataFrame, cut: int = 40) -> DataFrame:
    """Fuse the lists of a query's first three sub-queries (sub_query, rank) with weight 1; a single list that is left stays as it is."""
    first = Window.partitionBy("query_id").orderBy("sub_query")
    rows = results.withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= 3).drop("_n")
    lists = rows.groupBy("query_id").agg(F.count_distinct("sub_query").alias("lists"))
    fused = rows.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"), F.first("score").alias("own"), F.min(F.struct("sub_query", "source")).alias("first"))
    scored = fused.join(lists, "query_id").select("query_id", "chunk_id", F.round(F.when(F.col("lists") == 1, F.col("own")).otherwise(F.col("rrf")), 9).alias("score"), F.col("first.source").alias("source"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cut)


def first_stage(stages: list[DataFrame], group: str = "query_id") -> DataFrame:
    """For each group the rows of the first of ``stages`` that has any: a chain of fallbacks in one job."""
    rows = reduce(DataFrame.unionByName, (x.withColumn("stage", F.lit(i)) for i, x in enumerate(stages)))
    least = rows.groupBy(group).agg(F.min("stage").alias("stage"))
    return rows.join(least, [group, "stage"])
