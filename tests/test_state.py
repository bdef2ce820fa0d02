"""Versions of adaptive parameters, scans and merges, by hand."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storyloom.operators import adaptive, scanning

NOW = datetime(2024, 3, 1)


def later(hours):
    return F.lit(NOW + timedelta(hours=hours))


@pytest.fixture(scope="module")
def base(spark):
    params = adaptive.defaults(spark)
    return params, adaptive.bootstrap(spark.createDataFrame([], adaptive.VERSIONS), params, later(0))


def now(versions, at, param):
    return {r.param: (r.version, float(r.value), r.previous and float(r.previous)) for r in adaptive.as_of(versions, at).collect()}.get(param)


def test_bootstrap_adds_only_what_is_missing(spark, base):
    params, versions = base
    assert versions.count() == len(adaptive.DEFAULTS) == adaptive.bootstrap(versions, params, later(1)).count()
    some = versions.where("param LIKE 'predict%'")
    assert adaptive.bootstrap(some, params, later(0)).count() == len(adaptive.DEFAULTS)


def test_adjustments_are_clamped_and_versioned(spark, base):
    params, versions = base
    deltas = spark.createDataFrame(
        [("anomaly.volume_spike_threshold", Decimal("0.1"), "r"), ("predict.esc_anomaly_weight", Decimal("-0.5"), "r"), ("escalation.critical_threshold", Decimal("0.0"), "r"), ("unknown", Decimal("1"), "r")],
        "param string, delta decimal(7,4), reason string",
    )
    once = adaptive.adjust(versions, params, deltas, later(1))
    assert now(once, later(1), "anomaly.volume_spike_threshold") == (2, 2.1, 2.0)
    assert now(once, later(1), "predict.esc_anomaly_weight") == (2, 0.27, 0.3)  # a tenth at most
    assert now(once, later(1), "escalation.critical_threshold") == (1, 0.85, None)
    assert now(once, later(0.5), "anomaly.volume_spike_threshold") == (1, 2.0, None)  # as of before
    up = spark.createDataFrame([("escalation.critical_threshold", Decimal("0.08"), "r")] * 2, "param string, delta decimal(7,4), reason string")
    twice = adaptive.adjust(adaptive.adjust(versions, params, up, later(1)), params, up, later(2))
    assert now(twice, later(2), "escalation.critical_threshold") == (3, 0.98, 0.93)  # the greatest value


def test_rollback_and_reset(spark, base):
    params, versions = base
    name = spark.createDataFrame([("anomaly.entity_surge_threshold",)], "param string")
    assert adaptive.rollback(versions, name, later(1)).count() == versions.count()  # nothing before
    up = name.select("param", F.lit(0.1).cast("decimal(7,4)").alias("delta"), F.lit("r").alias("reason"))
    changed = adaptive.adjust(adaptive.adjust(versions, params, up, later(1)), params, up, later(2))
    assert now(changed, later(2), "anomaly.entity_surge_threshold") == (3, 2.7, 2.6)
    back = adaptive.rollback(changed, name, later(3))
    assert now(back, later(3), "anomaly.entity_surge_threshold") == (4, 2.6, 2.7)
    again = adaptive.rollback(back, name, later(4))
    assert now(again, later(4), "anomaly.entity_surge_threshold") == (5, 2.7, 2.6)  # back and forth
    assert now(adaptive.reset(again, params, name, later(5)), later(5), "anomaly.entity_surge_threshold") == (6, 2.5, 2.7)


def test_value_falls_back(spark, base):
    params, versions = base
    names = spark.createDataFrame([("anomaly.volume_spike_threshold",), ("none",)], "param string")
    got = {r.param: float(r.value) for r in adaptive.value(versions, params, names, F.lit(NOW - timedelta(days=1))).collect()}
    assert got == {"anomaly.volume_spike_threshold": 2.0, "none": 1.0}


@pytest.mark.parametrize(
    ("anomalies", "kinds", "want"),
    [
        (5, ["false_positive"] * 3 + ["useful"] * 4, 0.1),  # 3 of 7: .428
        (5, ["false_positive"] * 2 + ["useful"] * 3, None),  # .40 isn't over
        (4, ["false_positive"] * 3, None),
        (5, ["false_positive"] * 2, None),
        (5, ["confirmed"] * 3, -0.05),
        (5, ["other"] * 3, None),
        (5, ["false_positive"] * 3 + ["useful"] * 17, None),  # .15 isn't under
        (5, ["false_positive"] * 1 + ["useful"] * 6, -0.05),
    ],
)
def test_anomaly_deltas(spark, anomalies, kinds, want):
    rows = [(i, "volume_spike", NOW) for i in range(anomalies)] + [(99, "volume_spike", NOW - timedelta(days=40))]
    feedback = spark.createDataFrame([("anomaly", i % anomalies, k) for i, k in enumerate(kinds)] + [("event", 0, "false_positive"), ("anomaly", 99, "false_positive")], "target_type string, target_id long, kind string")
    got = adaptive.anomaly_deltas(spark.createDataFrame(rows, "anomaly_id long, type string, created_at timestamp"), feedback, F.lit(NOW - timedelta(days=30))).collect()
    assert [(r.param, float(r.delta)) for r in got] == ([("anomaly.volume_spike_threshold", want)] if want else [])


def test_weight_and_escalation_deltas(spark):
    factors = ", ".join(f"{f} double" for f in adaptive.FACTORS)
    predictions = spark.createDataFrame([(i, *((0.5, 0.5, 0.9, 0.5, 0.54) if i < 5 else (0.4, 0.6, 0.9, 0.5, 0.5))) for i in range(10)], f"prediction_id long, {factors}")
    outcome = lambda n: spark.createDataFrame([(i, "accurate" if i < 3 else "partially_accurate" if i < 5 else "inaccurate", NOW) for i in range(n)], "prediction_id long, status string, resolved_at timestamp")
    since = F.lit(NOW - timedelta(days=30))
    assert {(r.param, float(r.delta)) for r in adaptive.weight_deltas(predictions, outcome(10), since).collect()} == {("predict.esc_anomaly_weight", 0.01), ("predict.esc_correlation_weight", -0.01)}
    assert adaptive.weight_deltas(predictions, outcome(9), since).count() == 0
    said = lambda right, fp: spark.createDataFrame([("event", "escalated_correctly", NOW)] * right + [("prediction", "false_positive", NOW)] * fp + [("anomaly", "false_positive", NOW)], "target_type string, kind string, created_at timestamp")
    got = {(a, b): [float(r.delta) for r in adaptive.escalation_deltas(said(a, b), since).collect()] for a, b in ((2, 3), (3, 3), (6, 1), (5, 1), (1, 3))}
    assert got == {(2, 3): [0.02], (3, 3): [], (6, 1): [-0.02], (5, 1): [], (1, 3): []}


def test_scan_reads_thresholds_as_of_its_time(spark, base):
    params, versions = base
    rows = [("k", "c", s, NOW - timedelta(hours=1)) for s in range(3)]  # three recent ones against a baseline of 1: 2.0
    reports = spark.createDataFrame(rows, "subject string, country string, source_id long, ts timestamp")
    conflicts = spark.createDataFrame([("k/c", NOW - timedelta(hours=12)), ("k/d", NOW - timedelta(hours=13)), ("k/e", NOW)], "key string, updated_at timestamp")
    known = spark.createDataFrame([("narrative_shift", "conflict_flag", "k/e", 0.0, 1.0, 1.5, "medium", 0.6, NOW - timedelta(hours=2), NOW, "active")], scanning.ANOMALY)
    found = lambda v: {(r.type, r.key) for r in scanning.scan(reports, conflicts, known, v, params, later(0)).collect()}
    assert found(versions) == {("volume_spike", "k/c"), ("source_diversity", "k/c"), ("location_surge", "c"), ("narrative_shift", "k/c")}
    up = spark.createDataFrame([("anomaly.volume_spike_threshold", Decimal("0.1"), "r")], "param string, delta decimal(7,4), reason string")
    assert ("volume_spike", "k/c") in found(adaptive.adjust(versions, params, up, later(1)))  # changed after the scan's time
    assert ("volume_spike", "k/c") not in found(adaptive.adjust(versions, params, up, later(0)))


def test_merges_keep_twelve_hours(spark):
    row = lambda key, hours, status="active": ("t", "m", key, 1.0, 2.0, 2.0, "medium", 0.5, NOW - timedelta(hours=hours), NOW - timedelta(hours=hours - 24), status)
    state = spark.createDataFrame([row("a", 12), row("b", 13), row("c", 1, "resolved"), row("d", 2, "acknowledged"), row("e", 30)], scanning.ANOMALY)
    found = spark.createDataFrame([("t", "m", k, 1.0, 9.0, 8.0, "critical", 1.0) for k in "abcdf"], "type string, metric string, key string, baseline double, current double, deviation double, severity string, confidence double")
    got = sorted((r.key, r.current, r.status, r.detected_at == NOW) for r in scanning.merge_anomalies(state, found, later(0)).collect())
    assert got == sorted([("a", 9.0, "active", False), ("b", 2.0, "active", False), ("b", 9.0, "active", True), ("c", 2.0, "resolved", False), ("c", 9.0, "active", True), ("d", 9.0, "acknowledged", False), ("e", 2.0, "expired", False), ("f", 9.0, "active", True)])
    pairs = "type string, a string, b string, score double, strength string, detected_at timestamp"
    state = spark.createDataFrame([("x", "a", "b", 0.3, "weak", NOW - timedelta(hours=12)), ("x", "a", "c", 0.3, "weak", NOW - timedelta(hours=13)), ("y", "a", "b", 0.3, "weak", NOW)], pairs)
    found = spark.createDataFrame([("x", "b", "a", 0.8, "strong"), ("x", "a", "b", 0.7, "strong"), ("x", "c", "a", 0.5, "moderate")], "type string, a string, b string, score double, strength string")
    got = {(r.type, r.a, r.b, r.score, r.detected_at == NOW) for r in scanning.merge_correlations(state, found, later(0)).collect()}
    assert got == {("x", "a", "b", 0.8, False), ("x", "a", "c", 0.3, False), ("x", "a", "c", 0.5, True), ("y", "a", "b", 0.3, True)}
