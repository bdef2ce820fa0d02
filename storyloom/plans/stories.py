"""Queries over stories, alerts, sources and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyloom.functions import scores
from storyloom.operators import dedup, events, graph, quality, stories, topics
from storyloom.plans import entities as en
from storyloom.plans.articles import RULES
from storyloom.plans.registry import register
from storyloom.plans.signals import T
from storyloom.sources import tables as tb

def _assigned(spark, sf, exact=None):
    """Articles' stories: entities are the parts of the order of an article's number, duplicates those of equal contents or openings."""
    rows = tb.articles(spark, sf)
    same = dedup.cascade([exact or dedup.exact(rows), dedup.paragraph(rows)], [1, 3])
    named = tb.article_entities(spark, sf).select("article_id", F.col("entity_id").alias("name"))
    return stories.assign(rows, named, same)


@register("clu1_story_assignment")
def story_assignment(spark, sf):
    return _assigned(spark, sf)


@register("clu5_stories")
def story_table(spark, sf):
    return stories.refresh(tb.articles(spark, sf), _assigned(spark, sf))


TOPIC_COUNTS = f"""rules(topic, label, kind, pattern, target) AS (VALUES {", ".join(str(r) for r in RULES)}),
la AS (SELECT article_id, lower(title) AS title, lower(content) AS body FROM articles),
lm AS (SELECT article_id, topic, label, kind FROM (SELECT *, CASE target WHEN 'title' THEN title WHEN 'body' THEN body ELSE title || chr(10) || body END AS t FROM la, rules)
  WHERE CASE kind WHEN 'regex' THEN regexp_matches(t, pattern)
    WHEN 'boolean' THEN len(list_filter(string_split(pattern, ' or '), lambda g: len(list_filter(string_split(g, ' and '), lambda x: NOT contains(t, trim(x)))) = 0)) > 0
    ELSE contains(t, lower(pattern)) END),
lt AS (SELECT article_id, topic, list(DISTINCT label) FILTER (kind != 'exclusion') AS labels FROM lm GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'exclusion') = 0),
tc AS (SELECT article_id, greatest(count(DISTINCT topic), len(list_distinct(flatten(list(labels))))) AS topics FROM lt GROUP BY 1)"""
def _importance(spark, sf):
    """Importance, and the exact duplicates; whole texts are scored once and made into keys once, and both written."""
    rows = tb.articles(spark, sf)
    scored = tb.written(quality.quality(rows).select("article_id", "source", "quality", "published_at"))
    exact = tb.written(dedup.exact(rows))
    trust = quality.source_reliability(scored, exact)
    return stories.importance(scored, _assigned(spark, sf, exact), trust, topics.match_rules(rows, RULES), F.lit("2024-01-20 00:00:00").cast("timestamp")), exact


@register("sco7_importance")
def importance(spark, sf):
    return _importance(spark, sf)[0].select("article_id", "importance")


@register("sco11_story_importance")
def story_importance(spark, sf):
    made, exact = _importance(spark, sf)
    kept = made.join(exact, "article_id", "left_anti")
    return kept.groupBy("story").agg(F.count("*").alias("articles"), scores.half_even(F.avg("importance")).alias("importance"))


ALERTS = f"""{tb.REPORTS}, ak AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM reports WHERE value >= 95),
alerts AS (SELECT sha256(concat_ws('|', subject, country, day)) AS dedup_key, subject, country, count(*) AS reports, arg_min(report_id, (ts, report_id)) AS report_id,
  CASE WHEN max(value) >= 99 THEN 'critical' WHEN max(value) >= 97 THEN 'high' ELSE 'medium' END AS severity FROM ak GROUP BY subject, country, day)"""


@register("clu26_alerts", f"WITH {ALERTS} SELECT dedup_key, subject, country, reports, report_id, severity FROM alerts")
def alert_table(spark, sf):
    return stories.alerts(tb.reports(spark, sf), 95)


@register("qry53_alert_stats", f"WITH {ALERTS} SELECT severity, subject, count(*) AS alerts, sum(reports)::BIGINT AS reports FROM alerts GROUP BY 1, 2")
def alert_stats(spark, sf):
    return stories.alerts(tb.reports(spark, sf), 95).groupBy("severity", "subject").agg(F.count("*").alias("alerts"), F.sum("reports").alias("reports"))


@register(
    "src13_due_sources",
    f"""WITH {tb.ARTICLES}, l AS (SELECT source, max(published_at) AS last_ts FROM articles GROUP BY 1), a AS (SELECT source, (epoch((SELECT max(published_at) FROM articles)) - epoch(last_ts)) / 60 AS minutes FROM l)
SELECT source, minutes::BIGINT AS minutes FROM a WHERE minutes >= 60""",
)
def due_sources(spark, sf):
    last = tb.articles(spark, sf).groupBy("source").agg(F.max("published_at").alias("last_ts"))
    now = last.agg(F.max("last_ts")).first()[0]
    minutes = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_ts")) / 60
    return last.select("source", minutes.cast("long").alias("minutes")).where("minutes >= 60")


@register(
    "src14_raw_upsert",
    "SELECT key, arg_max(page_id, page_id) AS page_id, count(*) AS versions FROM (SELECT page_id, md5(coalesce(html, '')) AS key FROM pages WHERE url != '') GROUP BY 1",
)
def raw_upsert(spark, sf):
    """The latest row of each content key."""
    rows = tb.read(spark, sf, "pages").where("url != ''").select("page_id", F.md5(F.coalesce("html", F.lit(""))).alias("key"))
    return rows.groupBy("key").agg(F.max("page_id").alias("page_id"), F.count("*").alias("versions"))


@register("src26_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "events", "lineitem", "pages", "labels", "embeddings", "conversations")))
def table_counts(spark, sf):
    out = None
    for name in ("documents", "events", "lineitem", "pages", "labels", "embeddings", "conversations"):
        own = tb.read(spark, sf, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@register(
    "grf12_mention_spikes",
    f"""WITH b AS (SELECT p_brand AS entity, l_shipdate::TIMESTAMP AS ts FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT entity, count(*) FILTER (ts >= {en.T} - INTERVAL 1 DAY) AS d1, count(*) FILTER (ts >= {en.T} - INTERVAL 7 DAY) AS d7, count(*) FILTER (ts < {en.T} - INTERVAL 7 DAY) AS prior7
  FROM b WHERE ts >= {en.T} - INTERVAL 14 DAY AND ts <= {en.T} GROUP BY 1)
SELECT entity, 'mention_spike' AS kind, CASE WHEN d1 > 5 * greatest(d7 / 7, 1) THEN 'high' ELSE 'medium' END AS severity, d1, d7, prior7 FROM c WHERE d1 >= 5 AND d1 >= 2 * greatest(d7 / 7, 1)
UNION ALL SELECT entity, 'rapid_growth', 'medium', d1, d7, prior7 FROM c WHERE prior7 >= 5 AND d7 >= 1.5 * prior7""",
)
def mention_spikes(spark, sf):
    """Brands as entities: parts are named too seldom for a week of five mentions."""
    brands = tb.read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    rows = tb.article_entities(spark, sf).join(brands, F.col("entity_id") == F.col("p_partkey")).select("entity", F.col("published_at").alias("ts"))
    return graph.mention_signals(rows, F.lit(en.AS_OF).cast("timestamp"))


@register("grf20_strength_stats", f"WITH {en.EDGES} SELECT CASE WHEN strength >= 0.7 THEN 'strong' WHEN strength >= 0.45 THEN 'moderate' ELSE 'weak' END AS level, count(*) AS edges, round(avg(strength), 6) AS mean, max(n) AS most FROM edges GROUP BY 1")
def strength_stats(spark, sf):
    level = scores.strength(F.col("strength")).alias("level")
    return en._edges(spark, sf).groupBy(level).agg(F.count("*").alias("edges"), F.round(F.avg("strength"), 6).alias("mean"), F.max("n").alias("most"))


@register(
    "grf18_ego_graph",
    f"""WITH {en.EDGES}, e AS (SELECT arg_max(a, (n, strength, -a, -b)) AS e FROM edges) SELECT a, b, n, strength FROM edges, e WHERE a = e OR b = e ORDER BY strength DESC, a, b LIMIT 50""",
)
def ego_graph(spark, sf):
    edges = en._edges(spark, sf)
    top = edges.orderBy(F.desc("n"), F.desc("strength"), "a", "b").limit(1).first()
    return graph.top_relationships(edges, F.lit(top.a if top else -1)).select("a", "b", "n", "strength")


@register(
    "ews9_subject_correlation",
    f"""WITH {tb.REPORTS}, s AS (SELECT DISTINCT subject, source_id FROM reports WHERE ts >= {T} - INTERVAL 24 HOUR AND ts <= {T}), c AS (SELECT subject, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.subject AS a, y.subject AS b, count(*) AS shared FROM s x JOIN s y ON x.source_id = y.source_id AND x.subject < y.subject GROUP BY 1, 2)
SELECT a, b, shared, round(shared / (ca.n + cb.n - shared), 6) AS jaccard FROM p JOIN c ca ON a = ca.subject JOIN c cb ON b = cb.subject WHERE shared / (ca.n + cb.n - shared) >= 0.1""",
)
def subject_correlation(spark, sf):
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    s = tb.reports(spark, sf).where((F.col("ts") >= as_of - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= as_of)).select("subject", "source_id").distinct()
    c = s.groupBy("subject").agg(F.count("*").alias("n"))
    p = s.withColumnRenamed("subject", "a").join(s.withColumnRenamed("subject", "b"), "source_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    p = p.join(c.select(F.col("subject").alias("a"), F.col("n").alias("na")), "a").join(c.select(F.col("subject").alias("b"), F.col("n").alias("nb")), "b")
    jaccard = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return p.where(jaccard >= 0.1).select("a", "b", "shared", F.round(jaccard, 6).alias("jaccard"))


@register(
    "qry15_related_reports",
    f"""WITH {tb.REPORTS}, {tb.PLACES}, o AS (SELECT lat AS la, lon AS lo, report_id AS me FROM places ORDER BY report_id LIMIT 1)
SELECT report_id, round(abs(lat - la) + abs(lon - lo), 6) AS distance FROM places, o WHERE report_id != me ORDER BY distance, report_id LIMIT 10""",
)
def related_reports(spark, sf):
    rows = tb.places(spark, sf)
    me = rows.orderBy("report_id").limit(1).first()
    distance = F.round(F.abs(F.col("lat") - F.lit(me.lat if me else 0.0)) + F.abs(F.col("lon") - F.lit(me.lon if me else 0.0)), 6)
    return rows.where(F.col("report_id") != F.lit(me.report_id if me else -1)).select("report_id", distance.alias("distance")).orderBy("distance", "report_id").limit(10)


@register(
    "qry49_source_health",
    f"""WITH {tb.REPORTS}, l AS (SELECT source_id, max(ts) AS last_ts, count(*) AS n FROM reports WHERE ts <= {T} GROUP BY 1)
SELECT CASE WHEN last_ts >= {T} - INTERVAL 12 HOUR THEN 'healthy' WHEN last_ts >= {T} - INTERVAL 48 HOUR THEN 'degraded' ELSE 'down' END AS health, count(*) AS sources, sum(n)::BIGINT AS reports FROM l GROUP BY 1""",
)
def source_health(spark, sf):
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    last = tb.reports(spark, sf).where(F.col("ts") <= as_of).groupBy("source_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    health = F.when(F.col("last_ts") >= as_of - F.expr("INTERVAL 12 HOURS"), "healthy").when(F.col("last_ts") >= as_of - F.expr("INTERVAL 48 HOURS"), "degraded").otherwise("down")
    return last.groupBy(health.alias("health")).agg(F.count("*").alias("sources"), F.sum("n").alias("reports"))


@register("qry56_case_summary", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, sum(length(text))::BIGINT AS characters, max(turn) AS last_turn FROM conversations GROUP BY 1")
def case_summary(spark, sf):
    rows = tb.read(spark, sf, "conversations")
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum((F.col("role") == "user").cast("int")).alias("user_turns"), F.sum(F.char_length("text")).alias("characters"), F.max("turn").alias("last_turn"))


@register(
    "val2_stratified_sample",
    "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 10",
)
def stratified_sample(spark, sf):
    """Ten documents of each language, by a hash; the rank is cut before rows are moved."""
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    return tb.read(spark, sf, "documents").select("lang", "doc_id").withColumn("r", r).where("r <= 10").select("lang", "doc_id")


@register("val4_dataset_stats", "SELECT lang, source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def dataset_stats(spark, sf):
    tb.read(spark, sf, "documents").createOrReplaceTempView("documents_for_stats")
    return spark.sql("SELECT lang, source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean FROM documents_for_stats GROUP BY GROUPING SETS ((lang), (source), ())")


@register(
    "lrn23_accuracy_history",
    """WITH j AS (SELECT TIMESTAMP '2024-01-01' + doc_id * INTERVAL 7 MINUTE AS ts, quality, toxic FROM labels)
SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round((count(*) FILTER (quality = 1 AND toxic = 0) + 0.5 * count(*) FILTER (quality = 1 AND toxic = 1)) / count(*), 4)::DOUBLE AS accuracy FROM j GROUP BY 1""",
)
def accuracy_history(spark, sf):
    ts = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id * 7 AS int), 0)")
    good, half = ((F.col("quality") == 1) & (F.col("toxic") == v) for v in (0, 1))
    rows = tb.read(spark, sf, "labels").groupBy(F.date_trunc("hour", ts).alias("hour"))
    return rows.agg(F.count("*").alias("n"), F.round((F.sum(good.cast("int")) + 0.5 * F.sum(half.cast("int"))) / F.count("*"), 4).alias("accuracy"))


def _told(spark, sf):
    """Reports of 90 or more as stories: type, country (of some only its first word) and a title of both and a word more."""
    rows = tb.reports(spark, sf).where("value >= 90")
    place = F.when(F.col("report_id") % 5 == 0, F.substring_index("country", " ", 1)).when(F.col("report_id") % 7 == 0, None).otherwise(F.col("country"))
    kind = F.when(F.col("subject") != "view", F.col("subject"))
    title = F.concat_ws(" ", "subject", "country", F.concat(F.lit("w"), F.col("source_id") % 11), F.concat(F.lit("v"), F.col("report_id") % 13))
    return rows.select(F.col("report_id").alias("story"), title.alias("title"), kind.alias("type"), place.alias("place"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), (F.col("value") / 100).alias("importance"))


@register("clu7_event_resolution")
def event_resolution(spark, sf):
    return events.resolve(_told(spark, sf))


@register("clu8_events")
def event_table(spark, sf):
    rows = _told(spark, sf)
    return events.refresh(rows, events.resolve(rows))
