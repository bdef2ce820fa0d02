"""Adaptive parameters as a table of versions, and the learning cycle that adds to it.

versions: param, version (from 1), value, valid_from, reason. A change never overwrites: it adds the next version.
What a parameter is at a time is its last version valid from then or before, so a detector can be run again as of any
time, and a rollback is a new version too. defaults: param, type, value, low, high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameter, type, default, least and greatest value.
DEFAULTS = [
    ("anomaly.volume_spike_threshold", "anomaly_threshold", "2.0000", "0.5000", "5.0000"),
    ("anomaly.source_diversity_threshold", "anomaly_threshold", "2.0000", "0.5000", "5.0000"),
    ("anomaly.entity_surge_threshold", "anomaly_threshold", "2.5000", "0.5000", "6.0000"),
    ("anomaly.location_surge_threshold", "anomaly_threshold", "2.0000", "0.5000", "5.0000"),
    ("anomaly.narrative_shift_threshold", "anomaly_threshold", "1.5000", "0.3000", "4.0000"),
    ("predict.esc_anomaly_weight", "predictive_weight", "0.3000", "0.0500", "0.6000"),
    ("predict.esc_correlation_weight", "predictive_weight", "0.2000", "0.0500", "0.5000"),
    ("predict.esc_historical_weight", "predictive_weight", "0.2000", "0.0500", "0.5000"),
    ("predict.esc_velocity_weight", "predictive_weight", "0.2000", "0.0500", "0.5000"),
    ("predict.esc_source_div_weight", "predictive_weight", "0.1000", "0.0500", "0.4000"),
    ("source.positive_feedback_weight", "source_trust_weight", "0.0300", "0.0050", "0.0800"),
    ("source.negative_feedback_weight", "source_trust_weight", "0.0400", "0.0050", "0.0800"),
    ("escalation.high_threshold", "escalation_sensitivity", "0.7000", "0.4000", "0.9500"),
    ("escalation.critical_threshold", "escalation_sensitivity", "0.8500", "0.6000", "0.9800"),
]
#: The factor of a prediction that each weight is learnt from.
FACTORS = {"anomaly": "anomaly_weight", "correlation": "correlation_weight", "historical": "historical_weight", "source_diversity": "source_div_weight", "velocity": "velocity_weight"}
_DECIMAL = "decimal(7,4)"
_DEFAULTS = f"param string, type string, value {_DECIMAL}, low {_DECIMAL}, high {_DECIMAL}"
VERSIONS = f"param string, version int, value {_DECIMAL}, valid_from timestamp, reason string"
#: A change is at most this share of the value.
MOST = "0.10"


def defaults(spark: SparkSession) -> DataFrame:
    cast = [F.col(c).cast(_DECIMAL).alias(c) for c in ("value", "low", "high")]
    return spark.createDataFrame(DEFAULTS, "param string, type string, value string, low string, high string").select("param", "type", *cast)


def bootstrap(versions: DataFrame, params: DataFrame, at: Column) -> DataFrame:
    """versions, and a first version of each parameter that has none."""
    new = params.join(versions, "param", "left_anti")
    return versions.unionByName(new.select("param", F.lit(1).alias("version"), "value", at.alias("valid_from"), F.lit("default").alias("reason")))


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """(param, version, value, previous, reason) at a time: the last version, and the value of the one before."""
    last = F.max(F.struct("version", "value", "reason"))
    known = versions.where(F.col("valid_from") <= at)
    now = known.groupBy("param").agg(last.alias("now")).select("param", "now.*")
    before = known.select("param", (F.col("version") + 1).alias("version"), F.col("value").alias("previous"))
    return now.join(before, ["param", "version"], "left").select("param", "version", "value", "previous", "reason")


def value(versions: DataFrame, params: DataFrame, names: DataFrame, at: Column) -> DataFrame:
    """names (param) with the value at a time: of its version, else its default, else 1."""
    now, given = as_of(versions, at).select("param", "value"), params.select("param", F.col("value").alias("given"))
    found = names.join(now, "param", "left").join(given, "param", "left")
    return found.select(*names.columns, F.coalesce("value", "given", F.lit(1)).cast(_DECIMAL).alias("value"))


def _append(versions: DataFrame, changed: DataFrame, at: Column) -> DataFrame:
    new = changed.select("param", (F.col("version") + 1).cast("int").alias("version"), F.col("new").cast(_DECIMAL).alias("value"), at.alias("valid_from"), "reason")
    return versions.unionByName(new)


def adjust(versions: DataFrame, params: DataFrame, deltas: DataFrame, at: Column) -> DataFrame:
    """versions after deltas (param, delta, reason): each at most a tenth of the value, then within the bounds.

    A parameter without a version, or whose value doesn't change, gets none. Of several deltas of one parameter the
    first by reason counts.
    """
    one = deltas.groupBy("param").agg(F.min(F.struct("reason", "delta")).alias("d"))
    now = as_of(versions, at).select("param", "version", "value").join(params.select("param", "low", "high"), "param").join(one, "param")
    most = F.abs(F.col("value") * F.lit(MOST).cast("decimal(3,2)"))
    moved = F.col("value") + F.greatest(-most, F.least(most, F.col("d.delta").cast("decimal(7,4)")))
    new = F.greatest(F.col("low"), F.least(F.col("high"), moved)).cast(_DECIMAL)
    return _append(versions, now.select("param", "version", "value", new.alias("new"), F.col("d.reason").alias("reason")).where("new != value"), at)


def rollback(versions: DataFrame, params: DataFrame, at: Column) -> DataFrame:
    """versions, with one more for each of params (param) that has had another value before: that value."""
    now = as_of(versions, at).join(params.select("param").distinct(), "param", "left_semi").where("previous IS NOT NULL")
    return _append(versions, now.select("param", "version", F.col("previous").alias("new"), F.concat(F.lit("rollback from v"), F.col("version").cast("string")).alias("reason")), at)


def reset(versions: DataFrame, params: DataFrame, names: DataFrame, at: Column) -> DataFrame:
    """versions, with one more for each of names (param): the default."""
    now = as_of(versions, at).join(names.select("param").distinct(), "param", "left_semi").join(params.select("param", F.col("value").alias("new")), "param")
    return _append(versions, now.select("param", "version", "new", F.lit("reset").alias("reason")), at)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.col(whole)


def anomaly_deltas(anomalies: DataFrame, feedback: DataFrame, since: Column) -> DataFrame:
    """Deltas of the detectors' thresholds: anomalies (anomaly_id, type, created_at), feedback (target_type, target_id, kind).

    Types with five anomalies since then and three feedbacks on these: up by .1 where over .40 are false positives,
    down by .05 where under .15 are and more are confirmed or useful.
    """
    recent = anomalies.where(F.col("created_at") >= since).select("anomaly_id", "type")
    enough = recent.groupBy("type").agg(F.count("*").alias("n")).where("n >= 5")
    said = feedback.where("target_type = 'anomaly'").select(F.col("target_id").alias("anomaly_id"), "kind")
    counted = recent.join(said, "anomaly_id").groupBy("type").agg(
        F.count("*").alias("total"), F.count_if(F.col("kind") == "false_positive").alias("fp"), F.count_if(F.col("kind").isin("confirmed", "useful")).alias("good")
    )
    rate = _share("fp", "total")
    delta = F.when(rate > 0.40, F.lit("0.1")).when((rate < 0.15) & (F.col("good") > F.col("fp")), F.lit("-0.05"))
    out = counted.where("total >= 3").join(enough, "type", "left_semi")
    return out.select(F.concat(F.lit("anomaly."), F.col("type"), F.lit("_threshold")).alias("param"), delta.cast("decimal(7,4)").alias("delta"), F.lit("false positives").alias("reason")).where("delta IS NOT NULL")


def weight_deltas(predictions: DataFrame, outcomes: DataFrame, since: Column) -> DataFrame:
    """Deltas of the predictive weights: predictions (prediction_id, factors), outcomes (prediction_id, status, resolved_at).

    With ten resolved since then, some of them accurate and some not, a factor whose means differ by .05 or more moves its
    weight by .01 towards the accurate ones.
    """
    resolved = outcomes.where(F.col("resolved_at") >= since).select("prediction_id", "status")
    joined = resolved.join(predictions, "prediction_id", "left")
    right, wrong = F.col("status").isin("accurate", "partially_accurate"), F.col("status") == "inaccurate"
    means = [F.avg(F.when(side, F.col(f))).alias(f"{f}_{name}") for f in FACTORS for side, name in ((right, "right"), (wrong, "wrong"))]
    one = joined.agg(F.count("*").alias("n"), F.count_if(right).alias("rights"), F.count_if(wrong).alias("wrongs"), *means).where("n >= 10 AND rights > 0 AND wrongs > 0")
    rows = F.array(*[F.struct(F.lit(f"predict.esc_{w}").alias("param"), (F.col(f"{f}_right") - F.col(f"{f}_wrong")).alias("diff")) for f, w in FACTORS.items()])
    out = one.select(F.explode(rows).alias("r")).select("r.param", "r.diff").where(F.abs("diff") >= 0.05)
    return out.select("param", F.when(F.col("diff") > 0, F.lit("0.01")).otherwise(F.lit("-0.01")).cast("decimal(7,4)").alias("delta"), F.lit("accuracy").alias("reason"))


def escalation_deltas(feedback: DataFrame, since: Column) -> DataFrame:
    """The delta of the escalation threshold: of five feedbacks on events and predictions (right or false positive) since
    then, up by .02 where over half are false, down where under a fifth are and more than five are right."""
    recent = feedback.where((F.col("created_at") >= since) & F.col("target_type").isin("event", "prediction"))
    one = recent.agg(F.count_if(F.col("kind") == "escalated_correctly").alias("right"), F.count_if(F.col("kind") == "false_positive").alias("fp"))
    one = one.withColumn("total", F.col("right") + F.col("fp")).where("total >= 5")
    rate = _share("fp", "total")
    delta = F.when(rate > 0.50, F.lit("0.02")).when((rate < 0.20) & (F.col("right") > 5), F.lit("-0.02"))
    return one.select(F.lit("escalation.high_threshold").alias("param"), delta.cast("decimal(7,4)").alias("delta"), F.lit("escalations").alias("reason")).where("delta IS NOT NULL")


def learning_cycle(versions: DataFrame, params: DataFrame, anomalies: DataFrame, feedback: DataFrame, predictions: DataFrame, outcomes: DataFrame, at: Column, days: int = 30) -> DataFrame:
    """versions after one cycle over the last days: anomaly thresholds, predictive weights, escalation."""
    since = at - F.expr(f"INTERVAL {days} DAYS")
    deltas = anomaly_deltas(anomalies, feedback, since).unionByName(weight_deltas(predictions, outcomes, since)).unionByName(escalation_deltas(feedback, since))
    return adjust(versions, params, deltas, at)
