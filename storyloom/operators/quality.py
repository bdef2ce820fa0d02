"""Quality, importance and reliability of articles and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions import scores

SUB_SCORES = {"length": scores.length_score, "unique": scores.unique_score, "caps": scores.caps_score}


def quality(articles: DataFrame, least: float = 0.30, least_length: int = 100) -> DataFrame:
    """Adds the five sub-scores, their mean and whether the article passes; capitals don't count in Arabic articles."""
    content = F.coalesce("content", F.lit(""))
    out = articles.withColumn("title_score", scores.title_score(F.col("title")))
    for name, score in SUB_SCORES.items():
        out = out.withColumn(f"{name}_score", score(content))
    arabic = F.startswith(F.coalesce("language", F.lit("")), F.lit("ar"))
    out = out.withColumn("boilerplate_score", scores.boilerplate_score(content, arabic))
    others = F.col("title_score") + F.col("length_score") + F.col("unique_score") + F.col("boilerplate_score")
    # Each score once, since a filter on the quality writes them out.
    mean = (others + F.when(arabic, 0.0).otherwise(F.col("caps_score"))) / F.when(arabic, 4).otherwise(5)
    out = out.withColumn("quality", scores.half_even(mean))
    return out.withColumn("passed", (F.col("quality") >= least) & (F.char_length(content) >= least_length))


def source_reliability(scored: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Per source: articles, duplicates, low quality ones, mean quality and a trust score (from ten articles on)."""
    marked = scored.join(duplicates.select("article_id", F.lit(1).alias("dup")), "article_id", "left")
    out = marked.groupBy("source").agg(
        F.count("*").alias("articles"),
        F.sum(F.coalesce("dup", F.lit(0))).alias("duplicates"),
        F.sum((F.col("quality") < 0.3).cast("int")).alias("low_quality"),
        F.avg("quality").alias("mean_quality"),
    )
    ratio = F.col("duplicates") / F.col("articles")
    trust = F.greatest(F.lit(0.05), F.least(F.lit(1.0), 0.4 * F.col("mean_quality") + 0.3 * (1 - ratio) + 0.3))
    return out.withColumn("trust", F.when(F.col("articles") >= 10, F.round(trust, 4)))
