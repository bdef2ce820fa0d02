"""The entity graph: relationships, influence, neighbours and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.sources import tables as tb


def article_pairs(links: DataFrame) -> DataFrame:
    """(a, b, article_id, s, last): entities a < b of one article, a's sources there and its latest time.

    Pairs are made within an article, whose entities are few and distinct; links are shuffled by article only.
    """
    placed = links.where("article_id IS NOT NULL AND entity_id IS NOT NULL").select("article_id", "entity_id", "source_id", "published_at").repartition("article_id")
    own = placed.groupBy("article_id", "entity_id").agg(F.collect_set("source_id").alias("s"), F.max("published_at").alias("last"))
    other = placed.select("article_id", F.col("entity_id").alias("b")).distinct()
    return own.join(other, "article_id").where(F.col("entity_id") < F.col("b")).select(F.col("entity_id").alias("a"), "b", "article_id", "s", "last")


def scored(pairs: DataFrame, all_sources: DataFrame, as_of: Column, least: int = 2) -> DataFrame:
    """(a, b, n, sources, strength, confidence) for pairs (a, b, n, sources, last); all_sources is one row.

    Strength mixes the count, its age (a half-life of 30 days) and the share of all sources.
    """
    kept = pairs.where(F.col("n") >= least).crossJoin(F.broadcast(all_sources))  # one row
    diversity = F.least(F.lit(1.0), F.col("sources") / F.greatest(F.col("all_sources"), F.lit(1)))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("last")) / 86400
    strength = 0.40 * F.least(F.lit(1.0), F.log1p("n") / F.log(F.lit(101.0))) + 0.20 * F.pow(F.lit(2.0), -age / 30) + 0.25 * diversity + 0.15 * (1 - 1 / F.col("n"))
    confidence = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("n") / 8) + 0.15 * diversity)
    return kept.select("a", "b", "n", "sources", F.round(strength, 6).alias("strength"), F.round(confidence, 6).alias("confidence"))


def relationships(links: DataFrame, as_of: Column, days: int = 90, least: int = 2) -> DataFrame:
    """(a, b, n, sources, strength, confidence) for entities named together in `least` articles or more.

    A pair's sources are counted by key, not collected: each article counts in the row of its first source.
    """
    recent = links.where(F.col("published_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    rows = article_pairs(recent).select("a", "b", "last", F.posexplode_outer("s").alias("at", "source"))
    rows = rows.select("a", "b", "source", "last", F.when(F.col("at") > 0, 0).otherwise(1).alias("one"))
    by_source = tb.dealt(rows, links, "a", "b").groupBy("a", "b", "source").agg(F.sum("one").alias("n"), F.max("last").alias("last"))
    counted = by_source.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count("source").cast("int").alias("sources"), F.max("last").alias("last"))
    return scored(counted, links.agg(F.count_distinct("source_id").alias("all_sources")), as_of, least)


def mention_signals(mentions: DataFrame, as_of: Column) -> DataFrame:
    """(entity, kind, severity, d1, d7, prior7) for mentions (entity, ts).

    A spike: five mentions in a day and twice the week's daily mean, at least two; high above five times the mean (one
    at least). Rapid growth: five mentions in the week before, and half as many again in this one.
    """
    def back(days: int) -> Column:
        return F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS")

    counts = mentions.where(back(14) & (F.col("ts") <= as_of)).groupBy("entity").agg(F.count_if(back(1)).alias("d1"), F.count_if(back(7)).alias("d7"), F.count_if(~back(7)).alias("prior7"))
    mean = F.greatest(F.col("d7") / 7, F.lit(1.0))
    spike = counts.where((F.col("d1") >= 5) & (F.col("d1") >= 2 * mean)).select("entity", F.lit("mention_spike").alias("kind"), F.when(F.col("d1") > 5 * mean, "high").otherwise("medium").alias("severity"), "d1", "d7", "prior7")
    growth = counts.where("prior7 >= 5 AND d7 >= 1.5 * prior7").select("entity", F.lit("rapid_growth").alias("kind"), F.lit("medium").alias("severity"), "d1", "d7", "prior7")
    return spike.unionByName(growth)


def influence(links: DataFrame, edges: DataFrame, as_of: Column, least: int = 2) -> DataFrame:
    """Per entity of `least` articles or more: mentions in 1, 7, 30 and the prior 7 days, degree, sources, score and growth.

    The degree is the sum of the strengths of an entity's edges. The score mixes degree and week's mentions,
    each over the greatest of all, and the share of all sources; the flag `growing` asks for five mentions
    in a day and twice the week's daily mean.
    """
    def days(low: int, high: int = 0) -> Column:
        inside = F.col("published_at") >= as_of - F.expr(f"INTERVAL {low} DAYS")
        return F.sum((inside & (F.col("published_at") < as_of - F.expr(f"INTERVAL {high} DAYS")) if high else inside).cast("int"))

    counts = links.groupBy("entity_id").agg(
        F.count_distinct("article_id").alias("articles"), F.count_distinct("source_id").alias("sources"), days(1).alias("d1"), days(7).alias("d7"), days(30).alias("d30"), days(14, 7).alias("prior7")
    ).where(F.col("articles") >= least)
    ends = edges.select(F.explode(F.array("a", "b")).alias("entity_id"), "strength").groupBy("entity_id").agg((F.sum(F.round(F.col("strength") * 1_000_000).cast("long")) / 1_000_000).alias("degree"))  # exact, whatever the order
    out = tb.written(counts.join(ends, "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0))))
    most = out.agg(F.max("degree").alias("max_degree"), F.max("d7").alias("max_d7")).crossJoin(links.agg(F.count_distinct("source_id").alias("all_sources")))
    out = out.crossJoin(F.broadcast(most))  # one row
    velocity = F.col("d7") / F.greatest("max_d7", F.lit(1))
    degree = F.when(F.col("max_degree") > 0, F.col("degree") / F.col("max_degree")).otherwise(0.0)
    score = 0.40 * degree + 0.35 * velocity + 0.25 * F.col("sources") / F.greatest("all_sources", F.lit(1))
    growing = (F.col("d1") >= 5) & (F.col("d1") >= 2 * F.greatest(F.col("d7") / 7, F.lit(1.0)))
    return out.select("entity_id", "articles", "sources", "d1", "d7", "d30", "prior7", "degree", F.round(velocity, 4).alias("velocity"), F.round(score, 5).alias("influence"), growing.alias("growing"))


def neighbours(edges: DataFrame, start: int, hops: int = 2) -> DataFrame:
    """(node, hop): nodes within `hops` undirected steps of one node, each at its first hop."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node long, hop int")
    for hop in range(1, hops + 1):
        edge = seen.where(F.col("hop") == hop - 1).join(both, seen.node == both.a).select(F.col("b").cast("long").alias("node")).distinct()
        seen = seen.unionByName(edge.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop")))
    return seen


def top_relationships(edges: DataFrame, entity: Column | None = None, k: int = 50) -> DataFrame:
    kept = edges if entity is None else edges.where((F.col("a") == entity) | (F.col("b") == entity))
    return kept.orderBy(F.desc("strength"), "a", "b").limit(k)


def ranked(scored: DataFrame, score: str, k: int, key: str = "entity_id") -> DataFrame:
    """The k highest, numbered from 1; only those k rows are ever in one place."""
    top = scored.orderBy(F.desc(score), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def shortest_path(edges: DataFrame, start: DataFrame, goal: DataFrame, most: int = 6) -> DataFrame:
    """(hops, path): the shortest undirected way between two nodes (a row `node` each), of at most `most` edges; no row if none.

    A frontier is joined with the edges; each node keeps its first, then smallest, way. Nodes met before are not met again.
    """
    both = tb.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = tb.written(start.select(F.col("node").cast("long").alias("node"), F.lit(0).alias("hops"), F.array(F.col("node").cast("long")).alias("path")))
    for hop in range(1, most + 1):
        if not seen.join(goal, "node", "left_semi").isEmpty():
            break
        step = seen.where(F.col("hops") == hop - 1).join(both, F.col("node") == F.col("a"))
        step = step.groupBy(F.col("b").cast("long").alias("node")).agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        seen = tb.written(seen.unionByName(step.select("node", F.lit(hop).alias("hops"), F.concat("path", F.array("node")).alias("path"))))
    return seen.join(goal.select(F.col("node").cast("long").alias("node")), "node", "left_semi").select("hops", "path")


def entity_graph(edges: DataFrame, scored: DataFrame, least: float = 0.2, top: int = 50, most: int = 500) -> DataFrame:
    """The strongest edges that touch one of the `top` most influential entities."""
    chosen = F.broadcast(scored.orderBy(F.desc("influence"), "entity_id").limit(top).select("entity_id"))  # `top` rows
    strong = edges.where(F.col("strength") >= least)
    near = strong.join(chosen, strong.a == chosen.entity_id, "left_semi").unionByName(strong.join(chosen, strong.b == chosen.entity_id, "left_semi")).distinct()
    return near.orderBy(F.desc("strength"), "a", "b").limit(most)
