"""Queries over scores, factors, similarity, paths and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import scores
from storyloom.functions import text as tx
from storyloom.operators import early_warning as ew
from storyloom.operators import evaluation, graph, similarity, stories
from storyloom.plans.articles import CONTENT
from storyloom.plans.entities import EDGES, INFLUENCE, _edges, _influence
from storyloom.plans.registry import register
from storyloom.plans.signals import T, _as_of
from storyloom.plans.stories import ALERTS, _assigned
from storyloom.sources import tables as tb

# ---------------------------------------------------------------- anomalies, correlations, patterns of countries

#: Reports of 80 and more in the last day are the anomalies; two countries correlate by their anomalies' kinds and hours.
ANOMALIES = f"""{tb.REPORTS}, anomalies AS (SELECT report_id, country, subject, source_id, value, ts,
  CASE WHEN value >= 98 THEN 'critical' WHEN value >= 95 THEN 'high' WHEN value >= 88 THEN 'medium' ELSE 'low' END AS severity
  FROM reports WHERE value >= 80 AND ts >= {T} - INTERVAL 24 HOUR AND ts <= {T})"""
CORRELATIONS = f"""{ANOMALIES}, ck AS (SELECT DISTINCT country, subject || '/' || (hour(ts) // 4) AS signal FROM anomalies), cs AS (SELECT country, count(*) AS n FROM ck GROUP BY 1),
cp AS (SELECT x.country AS a, y.country AS b, count(*) AS common FROM ck x JOIN ck y ON x.signal = y.signal AND x.country < y.country GROUP BY 1, 2),
correlations AS (SELECT a, b, common, score, CASE WHEN score >= 0.7 THEN 'strong' WHEN score >= 0.45 THEN 'moderate' ELSE 'weak' END AS strength
  FROM (SELECT a, b, common, round(common / (x.n + y.n - common), 6) AS score FROM cp JOIN cs x ON x.country = a JOIN cs y ON y.country = b WHERE common / (x.n + y.n - common) >= 0.30))"""
FACTORS = f"""{CORRELATIONS}, fa AS (SELECT country, round(least(1.0, sum(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.4 ELSE 0.2 END::DOUBLE) / 3), 6) AS anomaly FROM anomalies GROUP BY 1),
fc AS (SELECT country, round(least(1.0, sum(CASE strength WHEN 'strong' THEN 1.0 WHEN 'moderate' THEN 0.5 ELSE 0.2 END::DOUBLE) / 2), 6) AS correlation FROM (SELECT unnest([a, b]) AS country, strength FROM correlations) GROUP BY 1),
fp AS (SELECT country, subject, avg(value) / 100 AS similarity FROM reports WHERE ts < {T} - INTERVAL 7 DAY GROUP BY 1, 2),
fh AS (SELECT country, round(least(1.0, avg(similarity)), 6) AS historical FROM fp GROUP BY 1),
fs AS (SELECT country, CASE WHEN count(DISTINCT source_id) >= 10 THEN 0.9 WHEN count(DISTINCT source_id) >= 5 THEN 0.7 WHEN count(DISTINCT source_id) >= 3 THEN 0.5 WHEN count(DISTINCT source_id) >= 2 THEN 0.3 ELSE 0.1 END::DOUBLE AS diversity
  FROM reports WHERE ts >= {T} - INTERVAL 24 HOUR AND ts <= {T} GROUP BY 1),
fn AS (SELECT country, count(*) FILTER (ts >= {T} - INTERVAL 6 HOUR) AS recent, count(*) FILTER (ts < {T} - INTERVAL 6 HOUR) AS earlier FROM reports WHERE ts >= {T} - INTERVAL 24 HOUR AND ts <= {T} GROUP BY 1),
fv AS (SELECT country, round(CASE WHEN earlier = 0 THEN least(1.0, recent / 5) WHEN ratio >= 3 THEN 0.9 WHEN ratio >= 2 THEN 0.7 WHEN ratio >= 1.5 THEN 0.5 WHEN ratio >= 1 THEN 0.3 ELSE 0.1 END::DOUBLE, 6) AS velocity
  FROM (SELECT *, (recent / 6) / greatest(earlier / 18, 0.1) AS ratio FROM fn))"""


def _anomalies(spark, sf):
    level = F.when(F.col("value") >= 98, "critical").when(F.col("value") >= 95, "high").when(F.col("value") >= 88, "medium").otherwise("low")
    inside = (F.col("ts") >= _as_of() - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= _as_of())
    return tb.reports(spark, sf).where(inside & (F.col("value") >= 80)).withColumn("severity", level)


def _correlations(spark, sf):
    signal = F.concat_ws("/", "subject", F.floor(F.hour("ts") / 4).cast("string"))
    pairs = similarity.overlap(_anomalies(spark, sf).withColumn("signal", signal), "country", "signal", least=0.30)
    return pairs.withColumn("strength", scores.strength(F.col("score")))


def _patterns(spark, sf):
    old = tb.reports(spark, sf).where(F.col("ts") < _as_of() - F.expr("INTERVAL 7 DAYS"))
    return old.groupBy("country", "subject").agg((F.avg("value") / 100).alias("similarity"))


@register("ews9_cross_event", f"WITH {CORRELATIONS} SELECT a, b, common, score, strength FROM correlations")
def cross_event(spark, sf):
    return _correlations(spark, sf)


@register("ews16_anomaly_factor", f"WITH {FACTORS} SELECT country, anomaly FROM fa")
def anomaly_factor(spark, sf):
    return ew.anomaly_factor(_anomalies(spark, sf), "country")


@register("ews17_correlation_factor", f"WITH {FACTORS} SELECT country, correlation FROM fc")
def correlation_factor(spark, sf):
    return ew.correlation_factor(_correlations(spark, sf), "country")


@register("ews18_historical_factor", f"WITH {FACTORS} SELECT country, historical FROM fh")
def historical_factor(spark, sf):
    return ew.historical_factor(_patterns(spark, sf), "country")


@register("ews19_diversity_factor", f"WITH {FACTORS} SELECT country, diversity FROM fs")
def diversity_factor(spark, sf):
    rows = tb.reports(spark, sf).where((F.col("ts") >= _as_of() - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= _as_of()))
    return rows.groupBy("country").agg(ew.diversity_factor(F.count_distinct("source_id")).alias("diversity"))


_ESCALATION = scores.half_even_sql("greatest(0.0, least(1.0, a * 0.30 + c * 0.20 + h * 0.20 + v * 0.20 + s * 0.10))::DOUBLE")
_CONTINUATION = scores.half_even_sql("greatest(0.0, least(1.0, v * 0.35 + s * 0.25 + a * 0.20 + c * 0.20))::DOUBLE")
_PRIORITY = scores.half_even_sql("greatest(0.0, least(1.0, greatest(escalation, continuation) * 0.60 + a * 0.25 + c * 0.15))::DOUBLE")


@register(
    "ews14_predictive_scores",
    f"""WITH {FACTORS}, j AS (SELECT country, coalesce(anomaly, 0) AS a, coalesce(correlation, 0) AS c, coalesce(historical, 0) AS h, velocity AS v, diversity AS s
  FROM fs JOIN fv USING (country) LEFT JOIN fa USING (country) LEFT JOIN fc USING (country) LEFT JOIN fh USING (country)),
p AS (SELECT *, {_ESCALATION} AS escalation, {_CONTINUATION} AS continuation, CASE WHEN s < 0.3 THEN 0.3 ELSE 0.0 END::DOUBLE AS misleading FROM j)
SELECT country, escalation, continuation, misleading, {_PRIORITY} AS priority FROM p""",
)
def predictive_scores(spark, sf):
    return ew.predictive_scores(tb.reports(spark, sf), _anomalies(spark, sf), _correlations(spark, sf), _patterns(spark, sf), "country", _as_of())


@register(
    "sco20_risk_trend",
    f"""WITH {FACTORS}, m AS (SELECT country, count(*) AS marked FROM anomalies WHERE ts >= {T} - INTERVAL 6 HOUR GROUP BY 1)
SELECT country, recent, earlier, CASE WHEN recent > 0 AND (recent * 3 > earlier OR coalesce(marked, 0) > 0) THEN 'rising' WHEN recent = 0 AND earlier > 0 THEN 'declining' ELSE 'stable' END AS trend
FROM fn LEFT JOIN m USING (country)""",
)
def risk_trend(spark, sf):
    return ew.risk_trend(tb.reports(spark, sf), _anomalies(spark, sf), "country", _as_of())


@register("ews11_cross_location", f"WITH {ANOMALIES} SELECT country, count(*) AS anomalies, round(least(1.0, count(*) / 10 + 0.3), 6) AS score FROM anomalies GROUP BY 1 HAVING count(*) >= 2")
def cross_location(spark, sf):
    return ew.cross_location(_anomalies(spark, sf), "country")


#: Lines with a discount of .09 or more are the anomalies of their supplier, the entity here.
@register(
    "ews10_cross_entity",
    """WITH able AS (SELECT l_suppkey AS entity FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1 HAVING count(*) >= 2),
o AS (SELECT DISTINCT l_orderkey AS article, l_suppkey AS entity FROM lineitem SEMI JOIN able ON l_suppkey = entity)
SELECT x.entity AS a, y.entity AS b, count(*) AS articles, round(least(1.0, count(*) / 20 + 0.3), 6) AS score FROM o x JOIN o y ON x.article = y.article AND x.entity < y.entity GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def cross_entity(spark, sf):
    lines = tb.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("entity_id"), "l_discount")
    return ew.cross_entity(lines.where("l_discount >= 0.09"), lines)


@register(
    "ews7_anomaly_upsert",
    f"""WITH {tb.REPORTS}, f AS (SELECT subject, country, arg_max(report_id, (ts, report_id)) AS report_id, arg_max(value, (ts, report_id)) AS value FROM reports WHERE value >= 80 AND ts > {T} - INTERVAL 6 HOUR AND ts <= {T} GROUP BY 1, 2),
k AS (SELECT DISTINCT subject, country FROM reports WHERE value >= 80 AND ts >= {T} - INTERVAL 12 HOUR AND ts <= {T} - INTERVAL 6 HOUR)
SELECT subject, country, report_id, value, CASE WHEN k.subject IS NULL THEN 'insert' ELSE 'update' END AS action FROM f LEFT JOIN k USING (subject, country)""",
)
def anomaly_upsert(spark, sf):
    rows, edge = tb.reports(spark, sf).where("value >= 80"), _as_of() - F.expr("INTERVAL 6 HOURS")
    return ew.upsert(rows.where(F.col("ts") <= edge), rows.where((F.col("ts") > edge) & (F.col("ts") <= _as_of())), ["subject", "country"], _as_of())


#: An event is a subject in a country in a week; a month has events old enough to be matched.
LATER = "2024-01-30 00:00:00"
WEEKS = f"""{tb.REPORTS}, w AS (SELECT subject || '/' || country || '/' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS event, subject AS type, country, source_id, value, ts FROM reports WHERE ts <= TIMESTAMP '{LATER}'),
events_ AS (SELECT event, type, country, count(DISTINCT source_id) AS sources, floor(avg(value)) / 100 AS importance, max(ts) AS ts FROM w GROUP BY 1, 2, 3)"""


@register(
    "ews24_historical_matches",
    f"""WITH {WEEKS}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY importance DESC, event) AS r FROM events_ WHERE ts < TIMESTAMP '{LATER}' - INTERVAL 14 DAY) WHERE r <= 50),
n AS (SELECT * FROM events_ WHERE ts >= TIMESTAMP '{LATER}' - INTERVAL 168 HOUR), m AS (SELECT DISTINCT event, source_id FROM w), z AS (SELECT event, count(*) AS size FROM m GROUP BY 1),
c AS (SELECT x.event AS e, y.event AS f, count(*) AS common FROM m x JOIN m y USING (source_id) GROUP BY 1, 2),
s AS (SELECT n.event, o.event AS match, round(0.25::DOUBLE + 0.25::DOUBLE * CASE WHEN n.country = o.country THEN 1 ELSE 0 END + 0.25::DOUBLE * (coalesce(common, 0) / (zn.size + zo.size - coalesce(common, 0)))
    + 0.15::DOUBLE * (1 - abs(n.sources - o.sources) / greatest(n.sources, o.sources)) + 0.10::DOUBLE * (1 - least(1.0::DOUBLE, abs(n.importance - o.importance))), 6) AS similarity
  FROM n JOIN o USING (type) JOIN z zn ON zn.event = n.event JOIN z zo ON zo.event = o.event LEFT JOIN c ON c.e = n.event AND c.f = o.event)
SELECT event, match, similarity FROM s WHERE similarity >= 0.35""",
)
def historical_matches(spark, sf):
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    w = tb.reports(spark, sf).where(F.col("ts") <= F.lit(LATER).cast("timestamp")).withColumn("event", F.concat_ws("/", "subject", "country", week))
    events = w.groupBy("event", F.col("subject").alias("type"), "country").agg(F.count_distinct("source_id").alias("sources"), (F.floor(F.avg("value")) / 100).alias("importance"), F.max("ts").alias("ts"))
    return ew.historical_matches(events, w.select("event", F.col("source_id").alias("entity")), F.lit(LATER).cast("timestamp"))


# ---------------------------------------------------------------- row rules


@register(
    "sco13_relevance",
    f"""WITH {tb.ARTICLES}, m AS (SELECT article_id, length(content) AS n, len(list_filter(string_split(lower({CONTENT}), ' '), lambda w: w = 'the')) AS mentions FROM articles)
SELECT article_id, mentions, CASE WHEN n < 100 THEN 0.5 WHEN mentions / (n / 500) >= 2 THEN 1.0 WHEN mentions / (n / 500) >= 1 THEN 0.8 WHEN mentions / (n / 500) >= 0.5 THEN 0.6 ELSE 0.4 END::DOUBLE AS relevance FROM m""",
)
def relevance(spark, sf):
    """How densely an article names one entity; here the commonest word stands for it."""
    mentions = F.size(F.filter(tx.words(F.col("content")), lambda w: w == "the"))
    rows = tb.articles(spark, sf).select("article_id", mentions.cast("long").alias("mentions"), F.char_length("content").alias("n"))
    return rows.select("article_id", "mentions", scores.relevance(F.col("mentions"), F.col("n")).alias("relevance"))


@register(
    "sco18_verification_status",
    f"""WITH {FACTORS}, p AS (SELECT country, {scores.half_even_sql("greatest(0.0, least(1.0, (diversity + historical) / 2))::DOUBLE")} AS confidence FROM fs JOIN fh USING (country))
SELECT country, confidence, CASE WHEN confidence >= 0.85 THEN 'verified' WHEN confidence >= 0.65 THEN 'likely_true' WHEN confidence >= 0.45 THEN 'unverified' WHEN confidence >= 0.25 THEN 'likely_misleading' ELSE 'misleading' END AS status FROM p""",
)
def verification_status(spark, sf):
    both = diversity_factor(spark, sf).join(historical_factor(spark, sf), "country")
    rows = both.select("country", scores.safe_decimal((F.col("diversity") + F.col("historical")) / 2).alias("confidence"))
    return rows.withColumn("status", scores.verification_status(F.col("confidence")))


# ---------------------------------------------------------------- similarity


@register(
    "sim3_entity_overlap",
    """WITH o AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), z AS (SELECT s, count(*) AS n FROM o GROUP BY 1),
c AS (SELECT x.s AS a, y.s AS b, count(*) AS common FROM o x JOIN o y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2)
SELECT a, b, common, round(common / (x.n + y.n - common), 6) AS score FROM c JOIN z x ON x.s = a JOIN z y ON y.s = b WHERE common / (x.n + y.n - common) >= 0.15""",
)
def entity_overlap(spark, sf):
    return similarity.overlap(tb.read(spark, sf, "lineitem"), "l_suppkey", "l_partkey", least=0.15)


@register(
    "sim7_context_score",
    """WITH o AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS p FROM lineitem), z AS (SELECT s, count(*) AS n FROM o GROUP BY 1)
SELECT x.s AS a, y.s AS b, count(*) AS shared, round(least(0.85, 0.5 + 0.7 * count(*) / any_value(n)), 6) AS score FROM o x JOIN o y ON x.p = y.p AND x.s != y.s JOIN z ON z.s = x.s GROUP BY 1, 2""",
)
def context_score(spark, sf):
    return similarity.context(tb.read(spark, sf, "lineitem"), "l_suppkey", "l_orderkey")


@register(
    "sim2_cosine",
    """SELECT x.vec_id, y.vec_id AS other, round(greatest(0, least(1, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]))), 6) AS score
FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""",
)
def cosine(spark, sf):
    rows = tb.read(spark, sf, "embeddings").select("vec_id", "embedding")
    other = rows.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e"))
    return rows.join(other, F.col("other") == F.col("vec_id") + 1).select("vec_id", "other", F.round(similarity.cosine(F.col("embedding"), F.col("e")), 6).alias("score"))


# ---------------------------------------------------------------- graph


@register(
    "grf16_shortest_path",
    f"""WITH RECURSIVE {EDGES}, bw AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT b, a FROM edges), deg AS (SELECT a, count(*) AS n FROM bw GROUP BY 1), r AS (SELECT (SELECT a FROM deg ORDER BY n DESC, a LIMIT 1) AS node, 0 AS hops UNION SELECT b, hops + 1 FROM r JOIN bw ON a = node WHERE hops < 6)
SELECT min(hops)::INTEGER AS hops FROM r WHERE node = (SELECT max(b) FROM edges) HAVING min(hops) IS NOT NULL""",
)
def shortest_path(spark, sf):
    edges = _edges(spark, sf)
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    start, goal = ends.orderBy(F.desc("count"), "node").limit(1).select("node"), edges.agg(F.max("b").alias("node"))
    return graph.shortest_path(edges, start, goal).select("hops")


@register(
    "grf9_entity_graph",
    f"""WITH {INFLUENCE}, t AS (SELECT entity_id FROM influence ORDER BY influence DESC, entity_id LIMIT 50)
SELECT a, b, n, strength FROM edges WHERE strength >= 0.2 AND (a IN (SELECT entity_id FROM t) OR b IN (SELECT entity_id FROM t)) ORDER BY strength DESC, a, b LIMIT 500""",
)
def entity_graph(spark, sf):
    edges = _edges(spark, sf)
    scored = _influence(spark, sf, edges)
    return graph.entity_graph(edges, scored).select("a", "b", "n", "strength")


# ---------------------------------------------------------------- evaluation and learning


@register(
    "val3_language_balance",
    f"""WITH {tb.ARTICLES}, s AS (SELECT language, greatest(10, floor(200 * count(*) / (SELECT count(*) FROM articles))) AS places FROM articles GROUP BY 1),
r AS (SELECT article_id, language, md5(article_id::VARCHAR) AS h, row_number() OVER (PARTITION BY language ORDER BY md5(article_id::VARCHAR)) AS r FROM articles)
SELECT article_id, r.language FROM r JOIN s ON r.language IS NOT DISTINCT FROM s.language ORDER BY r > places, CASE WHEN r > places THEN 0 ELSE r END, CASE WHEN r > places THEN h END, r.language, article_id LIMIT 200""",
)
def language_balance(spark, sf):
    return evaluation.language_balance(tb.articles(spark, sf), 200)


@register(
    "val14_entity_metrics",
    """WITH t AS (SELECT l_orderkey, l_partkey, lower(max(l_linestatus)) AS t FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_orderkey, l_partkey + CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS l_partkey, lower(max(CASE WHEN l_linenumber = 2 THEN 'x' ELSE l_linestatus END)) AS p FROM lineitem WHERE l_quantity >= 10 GROUP BY 1, 2),
c AS (SELECT coalesce(t, p) AS l_linestatus, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM t FULL JOIN p USING (l_orderkey, l_partkey) GROUP BY 1)
SELECT l_linestatus, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END::DOUBLE, 6) AS f1 FROM c""",
)
def entity_metrics(spark, sf):
    """An extractor that misses small lines, takes the next part for each order's first and gives its second another type."""
    lines = tb.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_linenumber", "l_quantity")
    wrong = (F.col("l_partkey") + F.when(F.col("l_linenumber") == 1, 1).otherwise(0)).alias("l_partkey")
    said = F.when(F.col("l_linenumber") == 2, "x").otherwise(F.col("l_linestatus")).alias("l_linestatus")
    return evaluation.entity_metrics(lines.where("l_quantity >= 10").select("l_orderkey", wrong, said), lines, "l_orderkey", "l_partkey", "l_linestatus")



@register(
    "val15_cluster_metrics",
    f"""WITH {tb.ARTICLES}, k AS (SELECT md5(substr(lower({CONTENT}), 1, 500)) AS predicted, source || '/' || coalesce(language, '') AS truth FROM articles),
p AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM k GROUP BY truth)) AS same, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM k WHERE predicted IS NOT NULL GROUP BY predicted)) AS merged,
  (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM k WHERE predicted IS NOT NULL GROUP BY truth, predicted)) AS both_same, (SELECT count(*) * (count(*) - 1) // 2 FROM k) AS every)
SELECT round(both_same / same, 6) AS same_event_accuracy, round((merged - both_same) / (every - same), 6) AS false_merge_rate, round(1 - both_same / same, 6) AS missed_grouping_rate, every::BIGINT AS total_pairs FROM p""",
)
def cluster_metrics(spark, sf):
    """Opening paragraphs (the key of dup4) against source and language."""
    truth = F.concat_ws("/", "source", F.coalesce("language", F.lit("")))
    opening = F.md5(F.substring(F.lower(tx.clean(F.col("content"))), 1, 500))
    return evaluation.cluster_metrics(tb.articles(spark, sf).select(opening.alias("predicted"), truth.alias("truth")), "truth", "predicted")


OUTCOMES = "outcomes AS (SELECT source, CASE WHEN quality = 1 AND toxic = 0 THEN 'accurate' WHEN quality = 1 OR toxic = 0 THEN 'partial' ELSE 'wrong' END AS outcome FROM labels JOIN documents USING (doc_id))"


@register(
    "lrn6_accuracy_stats",
    f"""WITH {OUTCOMES} SELECT source, count(*) AS total, count(*) FILTER (outcome = 'accurate') AS accurate, count(*) FILTER (outcome = 'partial') AS partial,
  round((count(*) FILTER (outcome = 'accurate') + 0.5::DOUBLE * count(*) FILTER (outcome = 'partial')) / count(*), 6) AS accuracy FROM outcomes GROUP BY 1""",
)
def accuracy_stats(spark, sf):
    rows = tb.read(spark, sf, "labels").join(tb.read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    return evaluation.accuracy(rows.select("source", F.when(good & clean, "accurate").when(good | clean, "partial").otherwise("wrong").alias("outcome")), "source")


@register(
    "lrn18_adjusted_thresholds",
    f"""WITH {tb.REPORTS}, t AS (SELECT subject AS name, round(avg(value), 6) AS current, round(quantile_cont(value, 0.5) - avg(value), 6) AS delta FROM reports GROUP BY 1)
SELECT name, current, delta, round(greatest(20.0, least(60.0, current + greatest(-abs(current * 0.1), least(abs(current * 0.1), delta))))::DOUBLE, 6) AS new FROM t""",
)
def adjusted_thresholds(spark, sf):
    """Thresholds at each subject's mean, to be moved to its median, within a tenth and from 20 to 60."""
    delta = F.round(F.percentile("value", F.lit(0.5)) - F.avg("value"), 6)
    rows = tb.reports(spark, sf).groupBy(F.col("subject").alias("name")).agg(F.round(F.avg("value"), 6).alias("current"), delta.alias("delta"))
    return evaluation.adjusted(rows.withColumns({"low": F.lit(20.0), "high": F.lit(60.0)})).select("name", "current", "delta", "new")


# ---------------------------------------------------------------- lists


@register("qry1_page", f"WITH {tb.ARTICLES} SELECT article_id, title, published_at FROM articles ORDER BY published_at DESC, article_id LIMIT 50 OFFSET 50")
def page(spark, sf):
    return tb.articles(spark, sf).select("article_id", "title", "published_at").orderBy(F.desc("published_at"), "article_id").offset(50).limit(50)


@register("qry2_sources_list", f"WITH {tb.ARTICLES} SELECT source, count(*) AS articles, max(published_at) AS last_ts FROM articles WHERE source ILIKE '%1%' GROUP BY 1")
def sources_list(spark, sf):
    return tb.articles(spark, sf).where(F.col("source").ilike("%1%")).groupBy("source").agg(F.count("*").alias("articles"), F.max("published_at").alias("last_ts"))


@register("qry7_stories_list")
def stories_list(spark, sf):
    return stories.refresh(tb.articles(spark, sf), _assigned(spark, sf)).where("articles >= 2").orderBy(F.desc("last_ts"), "story").limit(50).select("story", "last_ts", "articles")


@register("qry39_country_rollup", f"WITH {tb.REPORTS} SELECT country, count(*) AS events, count(DISTINCT subject) AS types, max(value) AS top, max(ts) AS last_ts FROM reports GROUP BY 1")
def country_rollup(spark, sf):
    return tb.reports(spark, sf).groupBy("country").agg(F.count("*").alias("events"), F.count_distinct("subject").alias("types"), F.max("value").alias("top"), F.max("ts").alias("last_ts"))


@register("qry46_high_priority", f"WITH {tb.REPORTS} SELECT report_id, subject, country, value, ts FROM reports WHERE value >= 90 AND ts <= {T} ORDER BY value DESC, ts DESC, report_id LIMIT 20")
def high_priority(spark, sf):
    rows = tb.reports(spark, sf).where((F.col("value") >= 90) & (F.col("ts") <= _as_of())).select("report_id", "subject", "country", "value", "ts")
    return rows.orderBy(F.desc("value"), F.desc("ts"), "report_id").limit(20)


@register("qry50_alerts_list", f"WITH {ALERTS} SELECT dedup_key, severity, subject, country FROM alerts WHERE severity IN ('critical', 'high') AND subject = 'error'")
def alerts_list(spark, sf):
    return stories.alerts(tb.reports(spark, sf), 95).where("severity IN ('critical', 'high') AND subject = 'error'").select("dedup_key", "severity", "subject", "country")


@register(
    "qry41_entity_timeline",
    f"""WITH {tb.LINKS}, e AS (SELECT min(entity_id) AS e FROM links), u AS (SELECT 'article' AS kind, article_id AS id, published_at AS ts FROM links JOIN e ON entity_id = e
UNION ALL SELECT 'order', o_orderkey, o_orderdate::TIMESTAMP FROM orders SEMI JOIN (SELECT article_id FROM links JOIN e ON entity_id = e) x ON o_orderkey = x.article_id)
SELECT kind, id, ts FROM u ORDER BY ts DESC, kind, id LIMIT 100""",
)
def entity_timeline(spark, sf):
    """What happened to one entity: its articles and the events that they belong to, newest first."""
    links = tb.article_entities(spark, sf)
    first = F.broadcast(links.agg(F.min("entity_id").alias("e")))  # one row
    own = links.join(first, F.col("entity_id") == F.col("e"))
    orders = tb.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    events = orders.join(own.select(F.col("article_id").alias("id")), "id", "left_semi").select(F.lit("order").alias("kind"), "id", "ts")
    both = own.select(F.lit("article").alias("kind"), F.col("article_id").alias("id"), F.col("published_at").alias("ts")).unionByName(events)
    return both.orderBy(F.desc("ts"), "kind", "id").limit(100)


@register(
    "clu18_source_correlation",
    f"""WITH {tb.REPORTS}, s AS (SELECT subject, date_trunc('day', ts) AS day, source_id, any_value(country) AS country, count(*) AS reports, min(ts) AS first_ts FROM reports GROUP BY 1, 2, 3)
SELECT subject, day, count(*) AS sources, count(DISTINCT country) AS independent, count(DISTINCT country) >= 2 AS confirmed, arg_min(source_id, (first_ts, source_id)) AS first_source, max(reports) AS most FROM s GROUP BY 1, 2""",
)
def source_correlation(spark, sf):
    """Per subject and day: sources, independent ones (different countries), confirmation and who was first."""
    by_source = tb.reports(spark, sf).groupBy("subject", F.date_trunc("day", "ts").alias("day"), "source_id", "country").agg(F.count("*").alias("reports"), F.min("ts").alias("first_ts"))
    out = by_source.groupBy("subject", "day").agg(
        F.count("*").alias("sources"), F.count_distinct("country").alias("independent"), F.min(F.struct("first_ts", "source_id")).alias("first"), F.max("reports").alias("most")
    )
    return out.select("subject", "day", "sources", "independent", (F.col("independent") >= 2).alias("confirmed"), F.col("first.source_id").alias("first_source"), "most")


@register("nrm14_arabic_key", f"""WITH {tb.ARTICLES} SELECT article_id, sha256(regexp_replace(translate(lower({CONTENT}), 'أإآٱءئؤىةـ', 'ااااااايه'), '[ً-ْٰ]', '', 'g')) AS key_sha256 FROM articles""")
def arabic_keys(spark, sf):
    return tb.articles(spark, sf).select("article_id", F.sha2(tx.arabic_key(F.col("content")), 256).alias("key_sha256"))
