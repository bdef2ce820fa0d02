"""Queries over state that changes: adaptive parameters, scans and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import scores
from storyloom.operators import adaptive, scanning, similarity
from storyloom.plans.registry import register
from storyloom.sources import tables as tb

START, CYCLE, BACK = "2024-01-01 00:00:00", "2024-01-31 00:00:00", "2024-02-01 00:00:00"
KINDS = {"view": "volume_spike", "signup": "source_diversity", "click": "entity_surge", "error": "location_surge", "purchase": "narrative_shift"}


def _at(time: str):
    return F.lit(time).cast("timestamp")


def _inputs(spark, sf):
    """Anomalies are reports of 80 or more, predictions all reports; feedback and its targets come from labels."""
    reports = tb.reports(spark, sf)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("subject"))
    anomalies = reports.where("value >= 80").select(F.col("report_id").alias("anomaly_id"), kind.alias("type"), F.col("ts").alias("created_at"))
    labels = tb.read(spark, sf, "labels")
    said = lambda target, good: labels.select(
        F.lit(target).alias("target_type"), F.col("doc_id").alias("target_id"),
        F.when(F.col("toxic") == 1, "false_positive").when(F.col("quality") == 1, good).otherwise("useful").alias("kind"), _at(CYCLE).alias("created_at"),
    )
    feedback = said("anomaly", "confirmed").unionByName(said("event", "escalated_correctly"))
    share = F.col("value") / 100
    predictions = reports.select(
        F.col("report_id").alias("prediction_id"), share.alias("anomaly"), ((F.col("source_id") % 10) / 10).alias("correlation"), (1 - share).alias("historical"), F.lit(0.5).alias("source_diversity"), (share / 2).alias("velocity")
    )
    status = F.when(F.col("value") >= 70, "accurate").when(F.col("value") >= 50, "partially_accurate").otherwise("inaccurate")
    outcomes = reports.where("report_id % 3 = 0").select(F.col("report_id").alias("prediction_id"), status.alias("status"), F.col("ts").alias("resolved_at"))
    return anomalies, feedback, predictions, outcomes


def _cycled(spark, sf):
    params = adaptive.defaults(spark)
    versions = adaptive.bootstrap(spark.createDataFrame([], adaptive.VERSIONS), params, _at(START))
    return params, adaptive.learning_cycle(versions, params, *_inputs(spark, sf), _at(CYCLE))


_SINCE = f"TIMESTAMP '{CYCLE}' - INTERVAL 30 DAY"
_TYPE = "CASE subject " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
_VALUES = ", ".join(f"('{p}', {v}::DECIMAL(7,4), {low}::DECIMAL(7,4), {high}::DECIMAL(7,4))" for p, _, v, low, high in adaptive.DEFAULTS)
_MEANS = " UNION ALL ".join(f"SELECT 'predict.esc_{w}' AS param, avg({f}) FILTER (good) - avg({f}) FILTER (NOT good) AS diff FROM o" for f, w in adaptive.FACTORS.items())
CYCLED = f"""{tb.REPORTS}, p(param, value, low, high) AS (VALUES {_VALUES}),
a AS (SELECT report_id AS id, {_TYPE} AS type FROM reports WHERE value >= 80 AND ts >= {_SINCE}),
f AS (SELECT type, count(*) AS total, count(*) FILTER (toxic = 1) AS fp, count(*) FILTER (toxic != 1) AS good FROM a JOIN labels ON doc_id = id GROUP BY 1),
ad AS (SELECT 'anomaly.' || type || '_threshold' AS param, CASE WHEN fp / total > 0.40 THEN 0.1 WHEN fp / total < 0.15 AND good > fp THEN -0.05 END AS delta, 'false positives' AS reason
  FROM f WHERE total >= 3 AND type IN (SELECT type FROM a GROUP BY 1 HAVING count(*) >= 5)),
o AS (SELECT value >= 50 AS good, value / 100 AS anomaly, (source_id % 10) / 10 AS correlation, 1 - value / 100 AS historical, 0.5::DOUBLE AS source_diversity, value / 200 AS velocity FROM reports WHERE report_id % 3 = 0 AND ts >= {_SINCE}),
wd AS (SELECT param, CASE WHEN diff > 0 THEN 0.01 ELSE -0.01 END AS delta, 'accuracy' AS reason FROM ({_MEANS}) WHERE abs(diff) >= 0.05 AND (SELECT count(*) >= 10 AND count(DISTINCT good) = 2 FROM o)),
e AS (SELECT count(*) FILTER (toxic = 1) AS fp, count(*) FILTER (toxic != 1 AND quality = 1) AS good FROM labels),
ed AS (SELECT 'escalation.high_threshold' AS param, CASE WHEN fp / (fp + good) > 0.5 THEN 0.02 WHEN fp / (fp + good) < 0.2 AND good > 5 THEN -0.02 END AS delta, 'escalations' AS reason FROM e WHERE fp + good >= 5),
d AS (FROM ad UNION ALL FROM wd UNION ALL FROM ed),
n AS (SELECT p.param, p.value AS old, greatest(low, least(high, p.value + greatest(-abs(p.value * 0.1), least(abs(p.value * 0.1), delta))))::DECIMAL(7,4) AS value, reason FROM p JOIN d USING (param) WHERE delta IS NOT NULL),
c AS (FROM n WHERE value != old),
versions AS (SELECT param, 1 AS version, value, TIMESTAMP '{START}' AS valid_from, 'default' AS reason FROM p UNION ALL SELECT param, 2, value, TIMESTAMP '{CYCLE}', reason FROM c)"""


@register("lrn14_learning_cycle", f"WITH {CYCLED} SELECT param, version, value::DOUBLE AS value, valid_from, reason FROM versions")
def learning_cycle(spark, sf):
    return _cycled(spark, sf)[1].withColumn("value", F.col("value").cast("double"))


@register(
    "lrn19_rollback",
    f"""WITH {CYCLED} SELECT p.param, CASE WHEN c.param IS NULL THEN 1 WHEN starts_with(p.param, 'anomaly.') THEN 3 ELSE 2 END AS version,
  CASE WHEN c.param IS NULL OR starts_with(p.param, 'anomaly.') THEN p.value ELSE c.value END::DOUBLE AS value, CASE WHEN starts_with(p.param, 'anomaly.') THEN c.value ELSE c.old END::DOUBLE AS previous FROM p LEFT JOIN c USING (param)""",
)
def rolled_back(spark, sf):
    """What all parameters are after the cycle and a rollback of the detectors' thresholds."""
    params, versions = _cycled(spark, sf)
    back = adaptive.rollback(versions, params.where("type = 'anomaly_threshold'"), _at(BACK))
    now = adaptive.as_of(back, _at(BACK))
    return now.select("param", "version", F.col("value").cast("double").alias("value"), F.col("previous").cast("double").alias("previous"))


NOW, EARLIER = "2024-01-20 06:00:00", "2024-01-20 00:00:00"


def _conflicts(spark, sf):
    """A conflict is a subject and country's error report of 97 or more."""
    return tb.reports(spark, sf).where("subject = 'error' AND value >= 97").select(F.concat_ws("/", "subject", "country").alias("key"), F.col("ts").alias("updated_at"))


def _scanned(spark, sf, at: str, known):
    params, versions = _cycled(spark, sf)
    return scanning.scan(tb.reports(spark, sf), _conflicts(spark, sf), known, versions, params, _at(at))


def _scan_sql(kind: str, metric: str, key: str, recent: int, least: int, time: str, count: str = "count(*)", scale: str | None = None) -> str:
    """One detector's rows over the reports with `event`, thresholds as of the time (all before the cycle, so the defaults)."""
    t = f"TIMESTAMP '{time}'"
    threshold = next(v for p, _, v, *_ in adaptive.DEFAULTS if p == f"anomaly.{kind}_threshold")
    return f"""SELECT '{kind}' AS type, '{metric}' AS metric, key, baseline, recent::DOUBLE AS current, deviation FROM (
  SELECT *, round((recent - baseline) / greatest(sqrt(baseline), 1.0), 6) AS deviation FROM (
    SELECT {key}::VARCHAR AS key, {count} FILTER (ts >= {t} - INTERVAL {recent} HOUR) AS recent,
      round(greatest({count} FILTER (ts < {t} - INTERVAL {recent} HOUR) {scale or f"/ {168 - recent} * {recent}"}, 1.0), 6) AS baseline
    FROM er WHERE ts >= {t} - INTERVAL 168 HOUR AND ts <= {t} GROUP BY 1)) WHERE deviation >= {threshold} AND recent >= {least}"""


def _scan_rows(time: str, known: str = "") -> str:
    parts = [
        _scan_sql("volume_spike", "report_count", "event", 6, 3, time),
        _scan_sql("source_diversity", "source_count", "event", 6, 3, time, "count(DISTINCT source_id)", "/ 6.75"),
        _scan_sql("entity_surge", "mention_count", "source_id", 6, 5, time),
        _scan_sql("location_surge", "event_count", "country", 12, 2, time),
    ]
    shifts = f"SELECT DISTINCT 'narrative_shift' AS type, 'conflict_flag' AS metric, event AS key, 0.0::DOUBLE AS baseline, 1.0::DOUBLE AS current, 1.5::DOUBLE AS deviation FROM er WHERE subject = 'error' AND value >= 97 AND ts >= TIMESTAMP '{time}' - INTERVAL 12 HOUR AND ts <= TIMESTAMP '{time}' {known}"
    rows = " UNION ALL ".join([*parts, shifts])
    return f"""SELECT *, CASE WHEN type = 'narrative_shift' THEN 'medium' WHEN deviation >= 4 THEN 'critical' WHEN deviation >= 3 THEN 'high' WHEN deviation >= 2 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN type = 'narrative_shift' THEN 0.6 ELSE greatest(0.2, round_even(least(1.0, 0.4 + (deviation - 1.5) * 0.15), 2)) END::DOUBLE AS confidence FROM ({rows})"""


EVENT_REPORTS = f"{tb.REPORTS}, er AS (SELECT *, subject || '/' || country AS event FROM reports)"


@register("ews1_anomaly_scan", f"WITH {EVENT_REPORTS} {_scan_rows(NOW)}")
def anomaly_scan(spark, sf):
    return _scanned(spark, sf, NOW, spark.createDataFrame([], scanning.ANOMALY))


@register(
    "ews7_two_scans",
    f"""WITH {EVENT_REPORTS}, x AS ({_scan_rows(EARLIER)}), y AS ({_scan_rows(NOW, "AND event NOT IN (SELECT key FROM x WHERE type = 'narrative_shift')")})
SELECT type, metric, key, x.baseline AS baseline, coalesce(y.current, x.current) AS current, coalesce(y.severity, x.severity) AS severity, TIMESTAMP '{EARLIER}' AS detected_at, TIMESTAMP '{EARLIER}' + INTERVAL 24 HOUR AS expires_at, 'active' AS status FROM x LEFT JOIN y USING (type, metric, key)
UNION ALL SELECT type, metric, key, y.baseline, current, severity, TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' + INTERVAL 24 HOUR, 'active' FROM y ANTI JOIN x USING (type, metric, key)""",
)
def two_scans(spark, sf):
    """State after a scan and another one six hours later."""
    state = spark.createDataFrame([], scanning.ANOMALY)
    for at in (EARLIER, NOW):
        state = tb.written(scanning.merge_anomalies(state, _scanned(spark, sf, at, state), _at(at)))
    return state.select("type", "metric", "key", "baseline", "current", "severity", "detected_at", "expires_at", "status")


def _pairs(spark, sf, at: str):
    """Countries with reports of 90 or more in the day before, by what sources they share."""
    day = (F.col("ts") >= _at(at) - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= _at(at)) & (F.col("value") >= 90)
    found = similarity.overlap(tb.reports(spark, sf).where(day).withColumn("signal", F.concat_ws("/", "subject", F.floor(F.hour("ts") / 6).cast("string"))), "country", "signal", least=0.30)
    return found.select(F.lit("cross_event").alias("type"), "a", "b", "score", scores.strength(F.col("score")).alias("strength"))


def _pairs_sql(time: str) -> str:
    t = f"TIMESTAMP '{time}'"
    own = f"SELECT DISTINCT country, subject || '/' || hour(ts) // 6 AS signal FROM reports WHERE ts >= {t} - INTERVAL 24 HOUR AND ts <= {t} AND value >= 90"
    return f"""SELECT a, b, round(common / (na + nb - common), 6) AS score FROM (SELECT x.country AS a, y.country AS b, count(*) AS common FROM ({own}) x JOIN ({own}) y ON x.signal = y.signal AND x.country < y.country GROUP BY 1, 2)
  JOIN (SELECT country AS a, count(*) AS na FROM ({own}) GROUP BY 1) USING (a) JOIN (SELECT country AS b, count(*) AS nb FROM ({own}) GROUP BY 1) USING (b) WHERE common / (na + nb - common) >= 0.30"""


_STRENGTH = "CASE WHEN score >= 0.7 THEN 'strong' WHEN score >= 0.45 THEN 'moderate' ELSE 'weak' END AS strength"


@register(
    "ews13_correlation_upsert",
    f"""WITH {tb.REPORTS}, x AS ({_pairs_sql(EARLIER)}), y AS ({_pairs_sql(NOW)}),
m AS (SELECT a, b, coalesce(y.score, x.score) AS score, TIMESTAMP '{EARLIER}' AS detected_at FROM x LEFT JOIN y USING (a, b) UNION ALL SELECT a, b, score, TIMESTAMP '{NOW}' FROM y ANTI JOIN x USING (a, b))
SELECT 'cross_event' AS type, a, b, score, {_STRENGTH}, detected_at FROM m""",
)
def correlation_upsert(spark, sf):
    """State after two runs six hours apart, the second with its pairs the other way round."""
    state = spark.createDataFrame([], "type string, a string, b string, score double, strength string, detected_at timestamp")
    state = tb.written(scanning.merge_correlations(state, _pairs(spark, sf, EARLIER), _at(EARLIER)))
    turned = _pairs(spark, sf, NOW).select("type", F.col("b").alias("a"), F.col("a").alias("b"), "score", "strength")
    return scanning.merge_correlations(state, turned, _at(NOW))
