"""Topic rules over articles, and text chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_rules(articles: DataFrame, rules: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """(article_id, topic, labels): topics whose rules match, without those that an exclusion rule takes away.

    rules: topic, label, kind (keyword, phrase, regex, boolean, exclusion), pattern, target (any, title,
    body). A boolean pattern is an OR of ANDs of terms. Rules are a list somebody wrote, so each is an
    expression over the article itself, and only what matches is ever moved.
    """
    title, body = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    targets = {"title": title, "body": body, "any": F.concat_ws("\n", title, body)}

    def hit(kind: str, pattern: str, target: Column) -> Column:
        if kind == "regex":
            return F.regexp_like(target, F.lit(pattern))
        groups = [[t.strip() for t in g.split(" and ")] for g in pattern.lower().split(" or ")] if kind == "boolean" else [[pattern.lower()]]
        whole = [reduce(Column.__and__, [F.contains(target, F.lit(t)) for t in g]) for g in groups]
        return reduce(Column.__or__, whole)

    found = [F.when(hit(kind, pattern, targets[target]), F.struct(F.lit(topic).alias("topic"), F.lit(label).alias("label"), F.lit(kind).alias("kind"))) for topic, label, kind, pattern, target in rules]
    matched = articles.select("article_id", F.explode(F.array_compact(F.array(*found))).alias("m")).select("article_id", "m.*")
    grouped = matched.groupBy("article_id", "topic").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != "exclusion", F.col("label")))).alias("labels"), F.max((F.col("kind") == "exclusion").cast("int")).alias("excluded")
    )
    return grouped.where((F.col("excluded") == 0) & (F.size("labels") > 0)).select("article_id", "topic", F.array_join("labels", ",").alias("labels"))


def chunks(articles: DataFrame, size: int = 4500) -> DataFrame:
    """(article_id, chunk, text): the content in stretches of at most `size` characters."""
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.char_length("content") / size).cast("int") - 1))
    return articles.select("article_id", "content", F.explode(parts).alias("chunk")).select("article_id", "chunk", F.expr(f"substring(content, chunk * {size} + 1, {size})").alias("text"))
