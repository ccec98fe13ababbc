"""Fusion of routes, re-ranking, score thresholds and the second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T


def rrf(vector: DataFrame, lexical: DataFrame, k: int = 60, keep: int = 50) -> DataFrame:
    """Reciprocal-rank fusion of two routes (query_id, key, rank)."""
    v = vector.select("query_id", "key", F.col("rank").alias("rank_v"))
    b = lexical.select("query_id", "key", F.col("rank").alias("rank_b"))
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    both = v.join(b, ["query_id", "key"], "full_outer").withColumn("fusion_score", F.round(part("rank_v") + part("rank_b"), 9))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), "key")))
    return ranked.where(F.col("rank") <= keep).select("query_id", "key", "rank_v", "rank_b", "fusion_score", "rank")


def rerank_overlap(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """``candidates`` with rerank_score: the share of a query's terms that the chunk has (an offline stand-in for a model)."""
    texts = chunks.select(F.col(key).alias("key"), T.search_terms(F.col("text")).alias("terms"))
    asked = queries.select("query_id", T.search_terms(F.col("query")).alias("asked"))
    joined = candidates.join(texts, "key").join(asked, "query_id")
    share = F.when(F.size("asked") == 0, 0.0).otherwise(F.size(F.array_intersect("asked", "terms")) / F.size("asked"))
    return joined.withColumn("rerank_score", F.round(share, 6)).drop("terms", "asked")


def score_guard(candidates: DataFrame, min_score: float = 0.3, keep: int = 4, fallback: int = 5) -> DataFrame:
    """Kept candidates (query_id, key, fusion_score, rerank_score) with final_rank and fallback.

    If any rerank score of a query is positive, those below ``min_score`` go; the first ``keep``
    stay. A query left with none gets its first ``fallback`` by fusion score, marked.
    """
    per_query = Window.partitionBy("query_id")
    any_rank = F.max(F.coalesce(F.col("rerank_score") > 0, F.lit(False))).over(per_query)
    order = F.when(F.col("rerank_score") > 0, F.col("rerank_score")).otherwise(F.coalesce("fusion_score", F.lit(-999.0)))
    marked = candidates.withColumn("_order", order).withColumn("_any", any_rank).withColumn("_good", ~F.col("_any") | F.coalesce(F.col("rerank_score") >= min_score, F.lit(False)))
    marked = marked.withColumn("_none", ~F.max("_good").over(per_query))
    chosen = marked.where(F.col("_good") | F.col("_none")).withColumn("_place", F.when(F.col("_none"), F.coalesce("fusion_score", F.lit(-999.0))).otherwise(F.col("_order")))
    ranked = chosen.withColumn("final_rank", F.row_number().over(per_query.orderBy(F.desc("_place"), "key")))
    return ranked.where(F.col("final_rank") <= F.when(F.col("_none"), fallback).otherwise(keep)).withColumn("fallback", F.col("_none")).drop("_order", "_any", "_good", "_none", "_place")


def second_pass(wide: DataFrame, k: int, min_score: float = 0.3, keep: int = 4, least: int = 2, relax: float = 0.8) -> DataFrame:
    """Guard over the first k candidates; queries with fewer than ``least`` kept try again over 2k with a lower bar.

    ``wide`` is ranked up to 2k once (query_id, key, rank, fusion_score, rerank_score). The second
    result replaces the first if it isn't smaller.
    """
    good = lambda df, bar: df.where(F.col("rerank_score") >= bar)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "key"))
    first = good(wide.where(F.col("rank") <= k), min_score).withColumn("final_rank", place).where(F.col("final_rank") <= keep)
    second = good(wide.where(F.col("rank") <= 2 * k), min_score * relax).withColumn("final_rank", place).where(F.col("final_rank") <= keep)
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("query_id")
    return first.join(enough, "query_id", "left_semi").withColumn("passes", F.lit(1)).unionByName(second.join(enough, "query_id", "left_anti").withColumn("passes", F.lit(2))).select("query_id", "key", "final_rank", "rerank_score", "passes")
