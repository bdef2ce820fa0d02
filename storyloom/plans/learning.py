"""Queries over feedback, evaluation and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import evolution
from storyloom.plans.registry import register
from storyloom.sources import tables as tb

FEEDBACK = """feedback AS (SELECT source, doc_id, CASE WHEN toxic = 1 THEN 'false_positive' WHEN quality = 1 THEN 'confirmed' ELSE 'useful' END AS kind FROM labels JOIN documents USING (doc_id))"""


def _feedback(spark, sf):
    kind = F.when(F.col("toxic") == 1, "false_positive").when(F.col("quality") == 1, "confirmed").otherwise("useful")
    return tb.read(spark, sf, "labels").join(tb.read(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id").select("source", "lang", "doc_id", kind.alias("kind"))


@register(
    "lrn3_feedback_stats",
    f"WITH {FEEDBACK} SELECT source, count(*) AS total, count(*) FILTER (kind = 'confirmed') AS confirmed, round(count(*) FILTER (kind = 'false_positive') / count(*), 4) AS false_positive_rate FROM feedback GROUP BY 1",
)
def feedback_stats(spark, sf):
    false = F.sum((F.col("kind") == "false_positive").cast("int"))
    return _feedback(spark, sf).groupBy("source").agg(F.count("*").alias("total"), F.sum((F.col("kind") == "confirmed").cast("int")).alias("confirmed"), F.round(false / F.count("*"), 4).alias("false_positive_rate"))


@register(
    "lrn8_reputation",
    f"""WITH {FEEDBACK}, c AS (SELECT source, count(*) FILTER (kind != 'false_positive') AS pos, count(*) FILTER (kind = 'false_positive') AS neg FROM feedback GROUP BY 1),
d AS (SELECT source, greatest(-0.05, least(0.05, 0.03 * pos - 0.04 * neg)) AS delta FROM c)
SELECT source, round(delta, 6) AS delta, round(greatest(0.10, least(0.95, 0.5 + delta)), 6) AS trust FROM d WHERE abs(delta) >= 0.001""",
)
def reputation(spark, sf):
    good = (F.col("kind") != "false_positive").cast("int")
    c = _feedback(spark, sf).groupBy("source").agg(F.sum(good).alias("pos"), F.sum(1 - good).alias("neg"))
    d = c.withColumn("delta", F.greatest(F.lit(-0.05), F.least(F.lit(0.05), 0.03 * F.col("pos") - 0.04 * F.col("neg")))).where(F.abs("delta") >= 0.001)
    return d.select("source", F.round("delta", 6).alias("delta"), F.round(F.greatest(F.lit(0.10), F.least(F.lit(0.95), 0.5 + F.col("delta"))), 6).alias("trust"))


@register(
    "lrn5_outcomes",
    f"""WITH {FEEDBACK}, c AS (SELECT source, count(*) AS n, count(*) FILTER (kind = 'confirmed') AS pos, count(*) FILTER (kind = 'false_positive') AS neg FROM feedback GROUP BY 1)
SELECT source, CASE WHEN neg / n >= 0.6 THEN 'inaccurate' WHEN pos / n >= 0.6 THEN 'accurate' WHEN pos > 0 AND neg > 0 THEN 'partial' ELSE 'indeterminate' END AS outcome FROM c""",
)
def outcomes(spark, sf):
    c = _feedback(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("kind") == "confirmed").cast("int")).alias("pos"), F.sum((F.col("kind") == "false_positive").cast("int")).alias("neg"))
    out = F.when(F.col("neg") / F.col("n") >= 0.6, "inaccurate").when(F.col("pos") / F.col("n") >= 0.6, "accurate").when((F.col("pos") > 0) & (F.col("neg") > 0), "partial").otherwise("indeterminate")
    return c.select("source", out.alias("outcome"))


@register(
    "val16_predicted_quality",
    """WITH j AS (SELECT lang, quality = 1 AS truth, n_chars >= 1000 AS said FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn FROM j GROUP BY 1)
SELECT lang, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE, 6) AS recall FROM c""",
)
def predicted_quality(spark, sf):
    j = tb.read(spark, sf, "labels").join(tb.read(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    truth, said = F.col("quality") == 1, F.col("n_chars") >= 1000
    c = j.groupBy("lang").agg(F.sum((truth & said).cast("int")).alias("tp"), F.sum((~truth & said).cast("int")).alias("fp"), F.sum((truth & ~said).cast("int")).alias("fn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return c.select("lang", "tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"))


@register(
    "sim14_semantic_search",
    """WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[])), 6) AS similarity
FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) DESC, vec_id LIMIT 10""",
)
def semantic_search(spark, sf):
    """The ten vectors nearest to one query, by exact cosine."""
    rows = tb.read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    query = rows.orderBy("vec_id").limit(1).first()
    q = F.lit(list(query.v)) if query else F.array().cast("array<double>")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    cosine = dot(F.col("v"), q) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(q, q))
    return rows.select("vec_id", "label", cosine.alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", "label", F.round("s", 6).alias("similarity"))


@register(
    "clu17_turns",
    """SELECT conv_id, turn, role, length(text) AS characters, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM conversations""",
)
def turns(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = tb.read(spark, sf, "conversations").select("conv_id", "turn", "role", F.char_length("text").alias("characters"))
    return rows.withColumn("previous", F.lag("role").over(w)).withColumn("so_far", F.sum("characters").over(w.rowsBetween(Window.unboundedPreceding, 0)))


@register(
    "qry45_overview",
    """SELECT (SELECT count(*) FROM documents) AS articles, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(*) FROM events) AS reports, (SELECT round(avg(value), 6) FROM events) AS mean_value,
  (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic, (SELECT count(*) FROM pages) AS pages""",
)
def overview(spark, sf):
    """One row of counts, from one row for each table."""
    parts = [
        tb.read(spark, sf, "documents").agg(F.count("*").alias("articles"), F.count_distinct("source").alias("sources")),
        tb.read(spark, sf, "events").agg(F.count("*").alias("reports"), F.round(F.avg("value"), 6).alias("mean_value")),
        tb.read(spark, sf, "labels").agg(F.sum((F.col("toxic") == 1).cast("int")).alias("toxic")),
        tb.read(spark, sf, "pages").agg(F.count("*").alias("pages")),
    ]
    out = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


@register("clu17_temporal_track")
def temporal_track(spark, sf):
    """The vectors of each label as the descriptions of one event, a minute apart."""
    rows = tb.read(spark, sf, "embeddings").select(F.col("label").alias("key"), F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 60).alias("ts"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return evolution.track(rows).select(F.col("key").alias("label"), F.col("id").alias("vec_id"), "is_change")
