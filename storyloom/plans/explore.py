"""Explorer lists, timelines and evaluation of duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import dedup, topics
from storyloom.plans.articles import EXACT, PARAGRAPH, RULES
from storyloom.plans.registry import register
from storyloom.plans.signals import T
from storyloom.plans.stories import TOPIC_COUNTS
from storyloom.sources import tables as tb


@register(
    "qry8_events_list",
    f"WITH {tb.REPORTS} SELECT report_id, subject, country, value, ts FROM reports WHERE subject = 'click' AND value >= 50 AND ts BETWEEN {T} - INTERVAL 5 DAY AND {T} ORDER BY value DESC, report_id LIMIT 50",
)
def events_list(spark, sf):
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    kept = tb.reports(spark, sf).where((F.col("subject") == "click") & (F.col("value") >= 50) & F.col("ts").between(as_of - F.expr("INTERVAL 5 DAYS"), as_of))
    return kept.select("report_id", "subject", "country", "value", "ts").orderBy(F.desc("value"), "report_id").limit(50)


@register("qry11_event_timeline", f"WITH {tb.REPORTS} SELECT subject, date_trunc('hour', ts) AS hour, count(*) AS reports, round(sum(value), 4) AS value, count(DISTINCT source_id) AS sources FROM reports GROUP BY 1, 2")
def event_timeline(spark, sf):
    out = tb.reports(spark, sf).groupBy("subject", F.date_trunc("hour", "ts").alias("hour"))
    return out.agg(F.count("*").alias("reports"), F.round(F.sum("value"), 4).alias("value"), F.count_distinct("source_id").alias("sources"))


@register(
    "qry42_topic_timeline",
    f"""WITH {tb.ARTICLES}, {TOPIC_COUNTS}, m AS (SELECT article_id, topic FROM lm GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'exclusion') = 0)
SELECT topic, date_trunc('day', published_at) AS day, count(*) AS articles FROM m JOIN articles USING (article_id) GROUP BY 1, 2""",
)
def topic_timeline(spark, sf):
    rows = tb.articles(spark, sf)
    found = topics.match_rules(rows, RULES).join(rows.select("article_id", "published_at"), "article_id")
    return found.groupBy("topic", F.date_trunc("day", "published_at").alias("day")).agg(F.count("*").alias("articles"))


@register(
    "qry47_watchlist_hits",
    f"""WITH {tb.ARTICLES}, {TOPIC_COUNTS} SELECT source, count(*) AS hits, sum(topics)::BIGINT AS topics FROM tc JOIN articles USING (article_id)
WHERE published_at >= TIMESTAMP '2024-01-05' - INTERVAL 48 HOUR AND published_at <= TIMESTAMP '2024-01-05' GROUP BY 1""",
)
def watchlist_hits(spark, sf):
    as_of = F.lit("2024-01-05 00:00:00").cast("timestamp")
    rows = tb.articles(spark, sf).where(F.col("published_at").between(as_of - F.expr("INTERVAL 48 HOURS"), as_of))
    counts = topics.match_rules(rows, RULES).groupBy("article_id").agg(F.count("*").alias("topics"))
    return counts.join(rows.select("article_id", "source"), "article_id").groupBy("source").agg(F.count("*").alias("hits"), F.sum("topics").alias("topics"))


@register(
    "val16_dedup_metrics",
    f"""WITH {tb.ARTICLES}, {EXACT}, {PARAGRAPH}, c AS (SELECT count(*) FILTER (e.article_id IS NOT NULL AND p.article_id IS NOT NULL) AS tp, count(*) FILTER (e.article_id IS NULL) AS fp, count(*) FILTER (p.article_id IS NULL) AS fn
  FROM exact e FULL JOIN paragraph p ON e.article_id = p.article_id AND e.duplicate_of = p.duplicate_of)
SELECT tp, fp, fn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM c""",
)
def dedup_metrics(spark, sf):
    """Opening-paragraph duplicates judged against exact ones, as pairs."""
    rows = tb.articles(spark, sf)
    truth, said = dedup.exact(rows).withColumn("t", F.lit(1)), dedup.paragraph(rows).withColumn("s", F.lit(1))
    joined = truth.join(said, ["article_id", "duplicate_of"], "full")
    count = {k: F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(k) for k, c in (("tp", F.col("t").isNotNull() & F.col("s").isNotNull()), ("fp", F.col("t").isNull()), ("fn", F.col("s").isNull()))}
    c, one = joined.agg(*count.values()), F.lit(1)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", F.round(tp / F.greatest(tp + fp, one), 6).alias("precision"), F.round(tp / F.greatest(tp + fn, one), 6).alias("recall"), F.round(2 * tp / F.greatest(2 * tp + fp + fn, one), 6).alias("f1"))


@register(
    "lrn15_threshold_adjustment",
    """WITH f AS (SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) / count(*) AS fp, count(*) FILTER (quality = 1) / count(*) AS confirmed FROM labels JOIN documents USING (doc_id) GROUP BY 1),
a AS (SELECT lang, n, 2.0 + CASE WHEN n < 3 THEN 0 WHEN fp > 0.40 THEN 0.1 WHEN fp < 0.15 AND confirmed > fp THEN -0.05 ELSE 0 END AS t FROM f)
SELECT lang, n, round(greatest(1.0, least(5.0, greatest(1.8, least(2.2, t))))::DOUBLE, 4) AS threshold FROM a""",
)
def threshold_adjustment(spark, sf):
    """A threshold of 2 moved by feedback: up with many false positives, down with few; at most a tenth at a time, in [1, 5]."""
    rows = tb.read(spark, sf, "labels").join(tb.read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    f = rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg((F.col("toxic") == 1).cast("int")).alias("fp"), F.avg((F.col("quality") == 1).cast("int")).alias("confirmed"))
    step = F.when(F.col("n") < 3, 0.0).when(F.col("fp") > 0.40, 0.1).when((F.col("fp") < 0.15) & (F.col("confirmed") > F.col("fp")), -0.05).otherwise(0.0)
    near = F.greatest(F.lit(1.8), F.least(F.lit(2.2), 2.0 + step))
    return f.select("lang", "n", F.round(F.greatest(F.lit(1.0), F.least(F.lit(5.0), near)), 4).alias("threshold"))


@register(
    "ent7_exact_merge",
    "SELECT lower(trim(p_brand)) AS name, p_type AS kind, count(*) AS variants, sum(p_size)::BIGINT AS mentions, min(p_partkey) AS first_key FROM part GROUP BY 1, 2",
)
def exact_merge(spark, sf):
    rows = tb.read(spark, sf, "part").groupBy(F.lower(F.trim("p_brand")).alias("name"), F.col("p_type").alias("kind"))
    return rows.agg(F.count("*").alias("variants"), F.sum("p_size").alias("mentions"), F.min("p_partkey").alias("first_key"))


@register("val17_value_summary", "SELECT event_type, count(*) AS n, round(min(value), 6) AS least, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY 1")
def value_summary(spark, sf):
    rows = tb.read(spark, sf, "events").groupBy("event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("least"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"))
