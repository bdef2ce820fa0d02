"""Evaluation: samples, set metrics and cluster metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def language_balance(articles: DataFrame, size: int, floor: int = 10) -> DataFrame:
    """`size` articles (all, if fewer), those of each language in its share of `size`, `floor` at least, first, by a hash;
    what is then missing is filled up with the others, by the hash.

    A language's articles are first ranked within parts, so that no task sorts all of them: behind the first `size` of
    a part none can be among the first `size` of the language.
    """
    shares = articles.groupBy("language").agg(F.count("*").alias("n"))
    total = shares.agg(F.sum("n").alias("total"))
    shares = shares.crossJoin(F.broadcast(total)).select(F.col("language").alias("of"), F.greatest(F.lit(floor), F.floor(size * F.col("n") / F.col("total"))).alias("places"))
    keyed = articles.select("article_id", "language", F.md5(F.col("article_id").cast("string")).alias("h"))
    part = Window.partitionBy("language", F.substring("h", 1, 2)).orderBy("h", "article_id")
    few = keyed.withColumn("r", F.row_number().over(part)).where(F.col("r") <= max(size, floor))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy("h", "article_id")))
    joined = ranked.join(shares, F.col("language").eqNullSafe(F.col("of"))).withColumn("more", F.col("r") > F.col("places"))
    return joined.orderBy("more", F.when(F.col("more"), 0).otherwise(F.col("r")), F.when(F.col("more"), F.col("h")), "language", "article_id").limit(size).select("article_id", "language")


def set_metrics(predicted: DataFrame, truth: DataFrame, on: list[str], by: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) for two sets of rows; `by` is one of the columns `on`."""
    marked = predicted.select(*on).distinct().withColumn("p", F.lit(1)).join(truth.select(*on).distinct().withColumn("t", F.lit(1)), on, "full")
    tp, fp, fn = (F.sum(F.coalesce(c.cast("int"), F.lit(0))) for c in (F.col("p").isNotNull() & F.col("t").isNotNull(), F.col("t").isNull(), F.col("p").isNull()))
    out = marked.groupBy(by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return out.select(by, "tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def entity_metrics(predicted: DataFrame, truth: DataFrame, article: str, name: str, kind: str) -> DataFrame:
    """(kind, tp, fp, fn, precision, recall, f1): names matched within an article, whatever their types.

    What is found or missed counts for the true type, what is wrong for the predicted one. Names are compared in lower
    case without outer spaces, empty ones don't count; of several types of a name the last in order counts.
    """
    def one(rows: DataFrame, as_: str) -> DataFrame:
        named = rows.select(F.col(article).alias("article"), F.lower(F.trim(F.col(name).cast("string"))).alias("name"), F.lower(F.col(kind).cast("string")).alias(as_))
        return named.where("name != ''").groupBy("article", "name").agg(F.max(as_).alias(as_))

    both = one(predicted, "p").join(one(truth, "t"), ["article", "name"], "full")
    out = both.groupBy(F.coalesce("t", "p").alias(kind)).agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    share = lambda whole: F.when(whole > 0, tp / whole).otherwise(0.0)
    return out.select(kind, "tp", "fp", "fn", F.round(share(tp + fp), 6).alias("precision"), F.round(share(tp + fn), 6).alias("recall"), F.round(F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0), 6).alias("f1"))


def cluster_metrics(clusters: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row over all pairs, by counts of pairs within groups instead of pairs; a null prediction is alone."""

    def pairs(keys: list[str], where: str) -> DataFrame:
        n = clusters.where(where).groupBy(*keys).agg(F.count("*").alias("n")) if keys else clusters.agg(F.count("*").alias("n"))
        return n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))

    known = f"`{predicted}` IS NOT NULL"
    same, merged, both, every = (pairs(*x).withColumnRenamed("pairs", n) for n, x in {"same": ([truth], "true"), "merged": ([predicted], known), "both_same": ([truth, predicted], known), "every": ([], "true")}.items())
    row = same.crossJoin(merged).crossJoin(both).crossJoin(every)  # one row each
    accuracy = F.when(F.col("same") > 0, F.col("both_same") / F.col("same")).otherwise(1.0)
    false = F.when(F.col("every") > F.col("same"), (F.col("merged") - F.col("both_same")) / (F.col("every") - F.col("same"))).otherwise(0.0)
    missed = F.when(F.col("same") > 0, 1 - F.col("both_same") / F.col("same")).otherwise(0.0)
    return row.select(F.round(accuracy, 6).alias("same_event_accuracy"), F.round(false, 6).alias("false_merge_rate"), F.round(missed, 6).alias("missed_grouping_rate"), F.col("every").alias("total_pairs"))


def accuracy(outcomes: DataFrame, by: str) -> DataFrame:
    """(by, total, accurate, partial, accuracy): a partial outcome counts half."""
    out = outcomes.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "accurate").alias("accurate"), F.count_if(F.col("outcome") == "partial").alias("partial"))
    return out.withColumn("accuracy", F.round((F.col("accurate") + 0.5 * F.col("partial")) / F.col("total"), 6))


def adjusted(thresholds: DataFrame, ratio: float = 0.10) -> DataFrame:
    """thresholds (name, current, low, high, delta) with `new`: the change within `ratio` of the current value, then within the bounds."""
    most = F.abs(F.col("current") * ratio)
    moved = F.col("current") + F.greatest(-most, F.least(most, F.col("delta")))
    return thresholds.withColumn("new", F.round(F.greatest(F.col("low"), F.least(F.col("high"), moved)), 6))
