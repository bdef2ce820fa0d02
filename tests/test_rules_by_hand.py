"""Temporal track against a loop; samples, name metrics and mention signals by hand."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from storyloom.operators import evaluation, evolution, graph

START = datetime(2024, 1, 1)


def plain_track(rows, most=200):
    def cosine(a, b):
        length = np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
        return max(0.0, min(1.0, float(np.dot(a, b)) / length)) if len(a) == len(b) and length > 0 else 0.0

    kept = {}
    for key, ts, i, v in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1], r[2])):
        own = kept.setdefault(key, [])
        near = [cosine(v, k[3]) if len(v) == len(k[3]) else 0.0 for k in own[-3:]]
        if near and near[-1] > 0.80:
            continue
        own.append((key, i, bool(near) and sum(near) / len(near) < 0.55, v))
    return {k[:3] for own in kept.values() for k in own[-most:]}


def test_track_is_a_loop(spark, sf):
    draw = random.Random(2)
    centres = [[draw.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    rows = []
    for i in range(400):
        c = centres[draw.randrange(3)]
        rows.append((draw.randrange(3), START + timedelta(minutes=draw.randrange(200)), i, [x + draw.gauss(0, 0.4) for x in c]))
    rows += [(7, START, 900, [0.0] * 4), (7, START, 901, [1.0, 0.0, 0.0, 0.0]), (7, START, 902, [1.0]), (None, START, 903, [1.0]), (7, None, 904, [1.0]), (7, START, 905, None)]
    entries = spark.createDataFrame(rows, "key long, ts timestamp, id long, vector array<double>")
    for most in (200, 5):
        assert {(r.key, r.id, r.is_change) for r in evolution.track(entries, most).collect()} == plain_track(rows, most)
    given = [(r.label, START, r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding IS NOT NULL").collect()]
    frame = spark.createDataFrame(given, "key long, ts timestamp, id long, vector array<double>")
    assert {(r.key, r.id, r.is_change) for r in evolution.track(frame).collect()} == plain_track(given)


def test_track_by_hand(spark):
    at = lambda m: START + timedelta(minutes=m)
    rows = [(1, at(0), 1, [1.0, 0.0]), (1, at(1), 2, [0.8, 0.6]), (1, at(2), 3, [0.81, 0.586]), (1, at(3), 4, [0.0, 1.0]), (1, at(4), 5, [-1.0, 0.0])]
    got = {r.id: r.is_change for r in evolution.track(spark.createDataFrame(rows, "key long, ts timestamp, id long, vector array<double>")).collect()}
    assert got == {1: False, 2: False, 4: True, 5: True}  # .80 isn't over .80; 3 is like 2


def test_balance_fills_up(spark):
    rows = [(i, "en") for i in range(80)] + [(100 + i, "fr") for i in range(4)] + [(200 + i, None) for i in range(16)]
    got = evaluation.language_balance(spark.createDataFrame(rows, "article_id long, language string"), 60).collect()
    assert len(got) == 60 == len({r.article_id for r in got})
    count = lambda lang: sum(r.language == lang for r in got)
    assert count("fr") == 4 and count(None) >= 10 and count("en") >= 46  # 48 and 10 and 4 are their places, 62 in all
    few = evaluation.language_balance(spark.createDataFrame(rows[:30], "article_id long, language string"), 60).collect()
    assert len(few) == 30


def test_names_match_whatever_their_types(spark):
    schema = "article long, name string, type string"
    truth = spark.createDataFrame([(1, "Ann", "PERSON"), (1, "Rome", "place"), (2, "Bob", "person"), (2, " ", "person")], schema)
    said = spark.createDataFrame([(1, " ann ", "org"), (1, "Oslo", "place"), (2, "Ann", "person"), (2, "", "org")], schema)
    got = {r.type: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluation.entity_metrics(said, truth, "article", "name", "type").collect()}
    assert got == {"person": (1, 1, 1, 0.5, 0.5), "place": (0, 1, 1, 0.0, 0.0)}


def test_mention_signals(spark):
    now = datetime(2024, 3, 15)
    made = lambda entity, d1, d7, prior: [(entity, now - timedelta(hours=1))] * d1 + [(entity, now - timedelta(days=3))] * (d7 - d1) + [(entity, now - timedelta(days=10))] * prior
    rows = made("spike", 5, 5, 0) + made("high", 6, 6, 0) + made("few", 4, 4, 0) + made("flat", 5, 21, 0) + made("grows", 0, 8, 5) + made("small", 0, 8, 4) + made("slow", 0, 7, 5)
    got = {(r.entity, r.kind, r.severity) for r in graph.mention_signals(spark.createDataFrame(rows, "entity string, ts timestamp"), F.lit(now)).collect()}
    assert got == {("spike", "mention_spike", "medium"), ("high", "mention_spike", "high"), ("grows", "rapid_growth", "medium")}


def test_bursts_are_sums_of_steps(spark):
    """Against all pairs, over midnights and ties; each anchor's set of types used to be collected from all rows ahead of it."""
    import random
    from datetime import datetime, timedelta

    from storyloom.operators import early_warning as ew

    draw = random.Random(4)
    rows = [(i, datetime(2024, 1, 1, 20) + timedelta(seconds=draw.choice([0, 600, 7200, 7201]) + 3600 * draw.randrange(12) + draw.randrange(3), microseconds=draw.choice([0, 999999])), draw.choice(["a", "b", "c", None])) for i in range(150)]
    df = spark.createDataFrame([*rows, (1000, None, "a")], "report_id long, ts timestamp, subject string")
    out = ew.bursts(df, least=10, least_types=3)
    want = {}
    for i, t, _ in rows:
        ahead = [s for _, u, s in rows if 0 <= (u.replace(microsecond=0) - t.replace(microsecond=0)).total_seconds() <= 7200]
        if len(ahead) >= 10 and len({*ahead} - {None}) >= 3:
            want[i] = (len(ahead), len({*ahead} - {None}))
    assert {r.report_id: (r.n, r.types) for r in out.collect()} == want and 20 < len(want) < 150
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()
