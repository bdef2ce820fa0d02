"""The anomaly scan: all detectors with thresholds as of a time, and merging what they and correlations find into state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import scores
from storyloom.operators import adaptive
from storyloom.operators import early_warning as ew

#: No threshold can be lower, so detectors are run with it and each key is then held against its threshold.
LOWEST = 0.3
ANOMALY = "type string, metric string, key string, baseline double, current double, deviation double, severity string, confidence double, detected_at timestamp, expires_at timestamp, status string"


def scan(reports: DataFrame, conflicts: DataFrame, known: DataFrame, versions: DataFrame, params: DataFrame, as_of: Column) -> DataFrame:
    """(type, metric, key, baseline, current, deviation, severity, confidence) of five detectors.

    reports: subject, country, source_id, ts; an event is a subject in a country, an entity a source. Spikes and
    diversity are of events, surges of entities and countries. conflicts (key, updated_at): events whose conflict flag
    was set; one of the last 12 hours is a narrative shift, unless known (type, key, detected_at) has one of that time.
    Detectors read their thresholds in versions as of the same time.
    """
    events = reports.withColumn("event", F.concat_ws("/", "subject", "country"))
    found = [
        ("volume_spike", "report_count", ew.surges(events, "event", as_of, 6, threshold=LOWEST, least=3), "event"),
        ("source_diversity", "source_count", ew.source_diversity(events, "event", "source_id", as_of, threshold=LOWEST, least=3), "event"),
        ("entity_surge", "mention_count", ew.surges(events, "source_id", as_of, 6, threshold=LOWEST, least=5), "source_id"),
        ("location_surge", "event_count", ew.surges(events, "country", as_of, 12, threshold=LOWEST, least=2), "country"),
    ]
    every = None
    for kind, metric, rows, key in found:
        own = rows.select(F.lit(kind).alias("type"), F.lit(metric).alias("metric"), F.col(key).cast("string").alias("key"), "baseline", F.col("recent").cast("double").alias("current"), "deviation")
        every = own if every is None else every.unionByName(own)
    names = reports.sparkSession.createDataFrame([(k, f"anomaly.{k}_threshold") for k, *_ in found], "type string, param string")
    every = every.join(F.broadcast(adaptive.value(versions, params, names, as_of).select("type", F.col("value").cast("double").alias("threshold"))), "type")  # four rows
    every = every.where(F.col("deviation") >= F.col("threshold")).drop("threshold")
    every = every.withColumns({"severity": scores.severity(F.col("deviation")), "confidence": scores.anomaly_confidence(F.col("deviation"))})
    recent = lambda c: (F.col(c) >= as_of - F.expr("INTERVAL 12 HOURS")) & (F.col(c) <= as_of)
    before = known.where(recent("detected_at") & (F.col("type") == "narrative_shift")).select("key")
    shifts = conflicts.where(recent("updated_at")).select(F.col("key").cast("string").alias("key")).distinct().join(before, "key", "left_anti")
    return every.unionByName(shifts.select(
        F.lit("narrative_shift").alias("type"), F.lit("conflict_flag").alias("metric"), "key", F.lit(0.0).alias("baseline"), F.lit(1.0).alias("current"),
        F.lit(1.5).alias("deviation"), F.lit("medium").alias("severity"), F.lit(0.6).alias("confidence"),
    ))


def merge_anomalies(state: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """state (ANOMALY) after a scan: what a row of the last 12 hours, active or acknowledged, has by type, metric and key
    gets the new values, the rest is added, active until a day later. Rows past their end become expired."""
    same = ["type", "metric", "key"]
    fresh = (F.col("detected_at") >= as_of - F.expr("INTERVAL 12 HOURS")) & F.col("status").isin("active", "acknowledged")
    news = found.select(*same, *[F.col(c).alias(f"new_{c}") for c in ("current", "deviation", "severity", "confidence")])
    updated = state.withColumn("fresh", fresh).join(news, same, "left")
    values = {c: F.when(F.col("fresh") & F.col("new_current").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("current", "deviation", "severity", "confidence")}
    status = F.when((F.col("status") == "active") & (F.col("expires_at") < as_of), "expired").otherwise(F.col("status"))
    kept = updated.withColumns({**values, "status": status}).select(*state.columns)
    added = found.join(state.where(fresh).select(*same).distinct(), same, "left_anti")
    more = {"detected_at": as_of, "expires_at": as_of + F.expr("INTERVAL 24 HOURS"), "status": F.lit("active")}
    return kept.unionByName(added.withColumns(more).select(*state.columns))


def merge_correlations(state: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """state (type, a, b, score, strength, detected_at) after found (type, a, b, score, strength): a pair, either way round,
    of the last 12 hours gets the new score, others are added. Of a pair found twice the higher score counts."""
    ends = {"a": F.least("a", "b"), "b": F.greatest("a", "b")}
    pairs = ["type", "a", "b"]
    one = found.select("type", *[v.alias(k) for k, v in ends.items()], "score", "strength").groupBy(*pairs).agg(F.max(F.struct("score", "strength")).alias("n"))
    own = state.select("type", *[v.alias(k) for k, v in ends.items()], "score", "strength", "detected_at")
    fresh = F.col("detected_at") >= as_of - F.expr("INTERVAL 12 HOURS")
    joined = own.withColumn("fresh", fresh).join(one, pairs, "left")
    new = F.col("fresh") & F.col("n").isNotNull()
    kept = joined.select(*pairs, F.when(new, F.col("n.score")).otherwise(F.col("score")).alias("score"), F.when(new, F.col("n.strength")).otherwise(F.col("strength")).alias("strength"), "detected_at")
    added = one.join(own.where(fresh).select(*pairs).distinct(), pairs, "left_anti")
    return kept.unionByName(added.select(*pairs, "n.score", "n.strength", as_of.alias("detected_at")))
