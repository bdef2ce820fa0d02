"""Queries over entity links: relationships, influence, explorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import graph
from storyloom.plans.registry import register
from storyloom.sources import tables as tb

AS_OF = "1998-06-01 00:00:00"
T = f"TIMESTAMP '{AS_OF}'"
EDGES = f"""{tb.LINKS}, o AS (SELECT DISTINCT article_id, entity_id, source_id, published_at FROM links WHERE published_at >= {T} - INTERVAL 3650 DAY),
p AS (SELECT x.entity_id AS a, y.entity_id AS b, x.article_id, x.source_id, x.published_at FROM o x JOIN (SELECT DISTINCT article_id, entity_id FROM o) y ON x.article_id = y.article_id AND x.entity_id < y.entity_id),
g AS (SELECT a, b, count(DISTINCT article_id) AS n, count(DISTINCT source_id) AS sources, max(published_at) AS last FROM p GROUP BY 1, 2 HAVING count(DISTINCT article_id) >= 2),
edges AS (SELECT a, b, n, sources, round(0.40 * least(1.0, ln(1 + n) / ln(101.0)) + 0.20 * pow(2.0, -(epoch({T}) - epoch(last)) / 86400 / 30) + 0.25 * sources / total + 0.15 * (1 - 1 / n), 6) AS strength,
  round(least(1.0, least(1.0, n / 8) + 0.15 * sources / total), 6) AS confidence FROM g, (SELECT count(DISTINCT source_id) AS total FROM links))"""


def _edges(spark, sf):
    """Written once: most queries use them several times, and pairs of a single article aren't among them."""
    return tb.written(graph.relationships(tb.article_entities(spark, sf), F.lit(AS_OF).cast("timestamp"), days=3650))


@register("grf1_relationships", f"WITH {EDGES} SELECT a, b, n, sources, strength, confidence FROM edges")
def relationships(spark, sf):
    return _edges(spark, sf)


@register("grf19_strongest", f"WITH {EDGES} SELECT a, b, n, strength FROM edges ORDER BY strength DESC, a, b LIMIT 50")
def strongest(spark, sf):
    return graph.top_relationships(_edges(spark, sf)).select("a", "b", "n", "strength")


INFLUENCE = f"""{EDGES}, d AS (SELECT entity_id, sum(round(strength * 1000000)::BIGINT) / 1000000 AS degree FROM (SELECT a AS entity_id, strength FROM edges UNION ALL SELECT b, strength FROM edges) GROUP BY 1),
c AS (SELECT entity_id, count(DISTINCT article_id) AS articles, count(DISTINCT source_id) AS sources, count(*) FILTER (published_at >= {T} - INTERVAL 1 DAY) AS d1, count(*) FILTER (published_at >= {T} - INTERVAL 7 DAY) AS d7,
  count(*) FILTER (published_at >= {T} - INTERVAL 30 DAY) AS d30, count(*) FILTER (published_at >= {T} - INTERVAL 14 DAY AND published_at < {T} - INTERVAL 7 DAY) AS prior7 FROM links GROUP BY 1 HAVING count(DISTINCT article_id) >= 2),
e AS (SELECT c.*, coalesce(degree, 0) AS degree, (SELECT count(DISTINCT source_id) FROM links) AS total FROM c LEFT JOIN d USING (entity_id)),
influence AS (SELECT *, round(d7 / greatest(1, max(d7) OVER ()), 4) AS velocity, d1 >= 5 AND d1 >= 2 * greatest(d7 / 7, 1.0) AS growing,
  round(0.40 * CASE WHEN max(degree) OVER () > 0 THEN degree / max(degree) OVER () ELSE 0 END + 0.35 * d7 / greatest(1, max(d7) OVER ()) + 0.25 * sources / total, 5) AS influence FROM e)"""


def _influence(spark, sf, edges=None):
    return graph.influence(tb.article_entities(spark, sf), edges or _edges(spark, sf), F.lit(AS_OF).cast("timestamp"))


@register("grf10_influence", f"WITH {INFLUENCE} SELECT entity_id, articles, sources, d1, d7, d30, prior7, degree, velocity, influence, growing FROM influence")
def influence(spark, sf):
    return _influence(spark, sf)


@register("grf11_influence_rank", f"WITH {INFLUENCE} SELECT entity_id, influence, row_number() OVER (ORDER BY influence DESC, entity_id) AS rank FROM influence ORDER BY influence DESC, entity_id LIMIT 100")
def influence_rank(spark, sf):
    return graph.ranked(_influence(spark, sf), "influence", 100).select("entity_id", "influence", "rank")


@register("grf14_fastest_growing", f"WITH {INFLUENCE} SELECT entity_id, velocity, d1, d7 FROM influence WHERE growing ORDER BY velocity DESC, entity_id LIMIT 20")
def fastest_growing(spark, sf):
    return _influence(spark, sf).where("growing").orderBy(F.desc("velocity"), "entity_id").limit(20).select("entity_id", "velocity", "d1", "d7")


@register("grf13_most_connected", f"WITH {INFLUENCE} SELECT entity_id, degree, influence FROM influence ORDER BY degree DESC, entity_id LIMIT 20")
def most_connected(spark, sf):
    return _influence(spark, sf).orderBy(F.desc("degree"), "entity_id").limit(20).select("entity_id", "degree", "influence")


@register(
    "grf15_neighbours",
    f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), s AS (SELECT 0 AS hop, min(a) AS node FROM edges),
h1 AS (SELECT DISTINCT b AS node FROM both_ways JOIN s ON a = node), h2 AS (SELECT DISTINCT b AS node FROM both_ways JOIN h1 ON a = node)
SELECT node, min(hop)::INTEGER AS hop FROM (SELECT node, 0 AS hop FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY 1""",
)
def neighbours(spark, sf):
    edges = _edges(spark, sf)
    start = edges.agg(F.min("a")).first()[0]
    return graph.neighbours(edges, start if start is not None else -1, 2)


@register(
    "qry26_co_occurrences",
    f"""WITH {tb.LINKS}, m AS (SELECT min(entity_id) AS e FROM links), mine AS (SELECT DISTINCT article_id FROM links JOIN m ON entity_id = e)
SELECT entity_id, count(DISTINCT article_id) AS articles, round(avg(mention_count), 6) AS mentions FROM links SEMI JOIN mine USING (article_id) WHERE entity_id != (SELECT e FROM m) GROUP BY 1 ORDER BY articles DESC, entity_id LIMIT 30""",
)
def co_occurrences(spark, sf):
    links = tb.article_entities(spark, sf)
    entity = links.agg(F.min("entity_id")).first()[0]
    mine = links.where(F.col("entity_id") == entity).select("article_id").distinct()
    out = links.join(mine, "article_id", "left_semi").where(F.col("entity_id") != entity).groupBy("entity_id")
    return out.agg(F.count_distinct("article_id").alias("articles"), F.round(F.avg("mention_count"), 6).alias("mentions")).orderBy(F.desc("articles"), "entity_id").limit(30)


@register(
    "qry24_entities_list",
    f"WITH {tb.LINKS} SELECT entity_id, count(DISTINCT article_id) AS articles, sum(mention_count) AS mentions, max(published_at) AS last_ts FROM links GROUP BY 1 HAVING count(DISTINCT article_id) >= 3",
)
def entities_list(spark, sf):
    out = tb.article_entities(spark, sf).groupBy("entity_id").agg(F.count_distinct("article_id").alias("articles"), F.sum("mention_count").alias("mentions"), F.max("published_at").alias("last_ts"))
    return out.where("articles >= 3")


@register(
    "qry14_top_entities",
    f"""WITH {tb.LINKS}, c AS (SELECT source_id, entity_id, count(*) AS n, round(avg(mention_count), 6) AS mentions FROM links GROUP BY 1, 2)
SELECT source_id, entity_id, n, mentions, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, entity_id) AS r FROM c) WHERE r <= 5""",
)
def top_entities(spark, sf):
    from pyspark.sql import Window

    c = tb.article_entities(spark, sf).groupBy("source_id", "entity_id").agg(F.count("*").alias("n"), F.round(F.avg("mention_count"), 6).alias("mentions"))
    r = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("n"), "entity_id"))
    return c.withColumn("rank", r).where("rank <= 5")


@register(
    "qry27_entity_timeline",
    f"WITH {tb.LINKS} SELECT entity_id, date_trunc('month', published_at) AS month, count(*) AS links, sum(mention_count) AS mentions FROM links GROUP BY 1, 2",
)
def entity_timeline(spark, sf):
    links = tb.article_entities(spark, sf)
    return links.groupBy("entity_id", F.date_trunc("month", "published_at").alias("month")).agg(F.count("*").alias("links"), F.sum("mention_count").alias("mentions"))
