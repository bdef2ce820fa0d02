"""Queries that add batches of articles to what is known instead of counting all again."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.plans import entities as en
from storyloom.plans.registry import register
from storyloom.sources import tables as tb
from storyloom.streaming import relationships as kept

FIRST, SECOND = "1997-06-01", "1998-06-01"


def _batches(rows, batches):
    """State after batches of links, each merged with what was before."""
    spark = rows.sparkSession
    pairs, sources = spark.createDataFrame([], kept.PAIRS), spark.createDataFrame([], "source_id long")
    for batch in batches:
        pairs = tb.written(kept.merged(pairs.select("a", "b", "n", "sources", "last"), kept.deltas(batch)))
        sources = tb.written(sources.unionByName(batch.select(F.col("source_id").cast("long").alias("source_id"))).distinct())
    return pairs, sources


@register("grf3_incremental_relationships", f"WITH {en.EDGES} SELECT a, b, n, sources, strength, confidence FROM edges")
def incremental_relationships(spark, sf):
    """All relationships from three batches of articles."""
    as_of = F.lit(en.AS_OF).cast("timestamp")
    rows = tb.article_entities(spark, sf)
    recent = rows.where(F.col("published_at") >= as_of - F.expr("INTERVAL 3650 DAYS"))
    pairs, _ = _batches(recent, [recent.where(F.col("article_id") % 3 == k) for k in range(3)])
    return kept.current(pairs, rows.select("source_id").distinct(), as_of)


def _families(spark, sf):
    """Links to families of parts, 200 of them."""
    return tb.article_entities(spark, sf).withColumn("entity_id", F.col("entity_id") % 200).where(F.col("published_at") < F.lit(SECOND).cast("timestamp"))


@register(
    "grf8_relationship_signals",
    f"""WITH {tb.LINKS}, first AS (SELECT article_id, max(published_at) < TIMESTAMP '{FIRST}' AS early FROM links WHERE published_at < TIMESTAMP '{SECOND}' GROUP BY 1),
o AS (SELECT DISTINCT article_id, entity_id % 200 AS entity_id, source_id, published_at FROM links WHERE published_at < TIMESTAMP '{SECOND}'),
p AS (SELECT x.entity_id AS a, y.entity_id AS b, article_id, x.source_id, x.published_at, early FROM o x JOIN (SELECT DISTINCT article_id, entity_id FROM o) y USING (article_id) JOIN first USING (article_id) WHERE x.entity_id < y.entity_id),
g AS (SELECT a, b, count(DISTINCT article_id) AS n, count(DISTINCT article_id) FILTER (early) AS before, count(DISTINCT article_id) FILTER (NOT early) AS fresh, count(DISTINCT source_id) AS sources, max(published_at) AS last FROM p GROUP BY 1, 2),
s AS (SELECT *, round(0.40 * least(1.0, ln(1 + n) / ln(101.0)) + 0.20 * pow(2.0, -(epoch(TIMESTAMP '{SECOND}') - epoch(last)) / 86400 / 30) + 0.25 * sources / (SELECT count(DISTINCT source_id) FROM o) + 0.15 * (1 - 1 / n), 6) AS strength FROM g WHERE fresh > 0),
k AS (SELECT a, b, n, before, CASE WHEN before = 0 AND n >= 3 AND strength >= 0.35 THEN 'new_relationship' WHEN before > 0 AND n >= 3 AND n - before >= 2 * before THEN 'unusual_pair' END AS kind FROM s)
SELECT a, b, kind, CASE WHEN kind = 'new_relationship' THEN 'medium' ELSE 'high' END AS severity, n, before FROM k WHERE kind IS NOT NULL""",
)
def relationship_signals(spark, sf):
    """Signals of a second batch of articles over the state of the first."""
    rows = _families(spark, sf)
    early = rows.groupBy("article_id").agg((F.max("published_at") < F.lit(FIRST).cast("timestamp")).alias("early"))
    dealt = rows.join(early, "article_id")
    pairs, sources = _batches(rows, [dealt.where("early").drop("early"), dealt.where("NOT early").drop("early")])
    found = kept.signals(pairs, sources, spark.createDataFrame([], kept.SIGNALS), F.lit(SECOND).cast("timestamp"))
    return found.select("a", "b", "kind", "severity", "n", "before")
