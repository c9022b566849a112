"""Merging of hits into scored results, their order and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelift.functions.vectors import DIGITS
from themelift.operators.positions import with_position
from themelift.schemas import METRICS, THEME_KEY

MIN_RELEVANCE = 0.4


def union_hits(hard: DataFrame, vector: DataFrame) -> DataFrame:
    return hard.unionByName(vector)


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row per theme and query text.

    Score parts are flags (2 for any substring hit, 1 for any vector hit), relevance is the
    highest of all hits, the matched keyword is the shortest, then the earliest, and the metrics
    are those of the lowest id among the hits. All of these combine before the shuffle, so a text
    with very many copies costs one row per task.
    """
    keyword_order = F.struct(F.length("keyword"), F.col("kw_pos"), F.col("keyword"))
    first = F.min(F.struct(F.col("id"), *[F.col(m) for m in METRICS]))
    merged = hits.groupBy(*THEME_KEY, "normalized_query").agg(
        F.max(F.when(F.col("method") == "hard", 2).otherwise(0)).alias("score_hard"),
        F.max(F.when(F.col("method") == "vector", 1).otherwise(0)).alias("score_vector"),
        F.round(F.max("relevance"), DIGITS).alias("Relevance"),
        F.min(keyword_order).alias("kw"),
        first.alias("first"),
    )
    return merged.select(
        *THEME_KEY,
        "normalized_query",
        "score_hard",
        "score_vector",
        (F.col("score_hard") + F.col("score_vector")).alias("Score"),
        "Relevance",
        F.col("kw.keyword").alias("matched_keyword"),
        *[F.col(f"first.{m}").alias(m) for m in METRICS],
    )


def relevance_floor(merged: DataFrame, min_rel: float = MIN_RELEVANCE) -> DataFrame:
    """Keep merged rows at or above the floor; hits below it have competed for the keyword."""
    return merged.where(F.col("Relevance") >= min_rel)


def result_order() -> list[Column]:
    """Score descending; ties are made total by relevance, page views and text."""
    return [
        F.col("Score").desc(),
        F.col("Relevance").desc(),
        F.col("SRPV").desc(),
        F.col("normalized_query"),
    ]


def rank(results: DataFrame, name: str = "rank_pos") -> DataFrame:
    """Add the 0-based place of each row in its theme's result order."""
    return with_position(results, THEME_KEY, result_order(), name)


def in_theme_order(results: DataFrame) -> DataFrame:
    """Themes in input order, each in result order: for the final sink only."""
    return results.orderBy("theme_pos", *result_order())


def score_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy(*THEME_KEY, "Score").agg(F.count(F.lit(1)).alias("n_queries"))


def hits_per_keyword(hits: DataFrame, keywords: DataFrame) -> DataFrame:
    """Hits of every keyword by method, keywords without any included."""
    key = ["theme_pos", "theme", "kw_pos", "keyword"]
    counted = hits.groupBy(*key).agg(
        F.count_if(F.col("method") == "hard").cast("bigint").alias("hard_hits"),
        F.count_if(F.col("method") == "vector").cast("bigint").alias("vector_hits"),
    )
    rows = keywords.select(*key).distinct().join(counted, key, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("hard_hits", "vector_hits")})


def floor_removed(merged: DataFrame, min_rel: float = MIN_RELEVANCE) -> DataFrame:
    return merged.groupBy(*THEME_KEY).agg(
        F.count(F.lit(1)).alias("merged_rows"),
        F.count_if(F.col("Relevance") < min_rel).cast("bigint").alias("removed_rows"),
    )
