"""Relationships from a stream of batches, with a restart, against all articles at once."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from storyloom.operators import graph
from storyloom.streaming import relationships

START = datetime(2024, 1, 1)
LINKS = "article_id long, entity_id long, source_id long, published_at timestamp"


def batch(draw, first, articles, day):
    rows = []
    for i in range(first, first + articles):
        ts = START + timedelta(days=day, minutes=draw.randrange(1440))
        rows += [(i, e, draw.randrange(5), ts) for e in draw.sample(range(8), draw.randint(1, 4)) for _ in range(draw.randint(1, 2))]
    return rows


def test_stream_with_a_restart_equals_all_at_once(spark, tmp_path):
    draw, folder, source = random.Random(1), f"{tmp_path}/state", tmp_path / "in"
    rows, files = [], 0

    def add(first, day):
        nonlocal files
        own = batch(draw, first, 12, day)
        rows.extend(own)
        spark.createDataFrame(own, LINKS).coalesce(1).write.mode("append").parquet(str(source))
        files += 1

    def run():
        stream = spark.readStream.schema(LINKS).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = stream.writeStream.foreachBatch(relationships.keep(folder)).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    add(0, 0)
    add(100, 1)
    run()
    add(200, 2)
    run()  # goes on where it was
    as_of = F.lit(START + timedelta(days=10))
    pairs, sources = relationships.state(spark, folder, files - 1)
    got = {tuple(r) for r in relationships.current(pairs, sources, as_of).collect()}
    want = {tuple(r) for r in graph.relationships(spark.createDataFrame(rows, LINKS), as_of).collect()}
    assert got == want and len(want) > 10
    # The last batch once more, as after a failure: nothing changes.
    again = spark.createDataFrame([r for r in rows if r[0] >= 200], LINKS)
    signals = {tuple(r) for r in relationships.sent(spark, folder).collect()}
    relationships.keep(folder)(again, files - 1)
    pairs, sources = relationships.state(spark, folder, files - 1)
    assert {tuple(r) for r in relationships.current(pairs, sources, as_of).collect()} == want
    assert {tuple(r) for r in relationships.sent(spark, folder).collect()} == signals and signals


def test_signals_by_hand(spark):
    at = lambda h: START + timedelta(hours=h)
    pair = lambda a, b, n, before, touched=True: (a, b, n, [1, 2], at(0), before, touched)
    rows = [pair(1, 2, 3, 0), pair(1, 3, 2, 0), pair(1, 4, 6, 2), pair(1, 5, 5, 2), pair(1, 6, 9, 0, False), pair(1, 7, 3, 1), (1, 8, 3, [1], at(-24 * 365), 0, True)]
    pairs = spark.createDataFrame(rows, f"{relationships.PAIRS}, before long, touched boolean")
    sources = spark.createDataFrame([(1,), (2,)], "source_id long")
    none = spark.createDataFrame([], relationships.SIGNALS)
    found = {(r.b, r.kind, r.severity) for r in relationships.signals(pairs, sources, none, F.lit(at(0))).collect()}
    assert found == {(2, "new_relationship", "medium"), (4, "unusual_pair", "high"), (7, "unusual_pair", "high")}
    sent = spark.createDataFrame([(1, 2, "new_relationship", "medium", 3, 0, at(-24)), (1, 4, "unusual_pair", "high", 3, 1, at(-25)), (1, 7, "new_relationship", "medium", 3, 0, at(-1))], relationships.SIGNALS)
    assert {r.b for r in relationships.signals(pairs, sources, sent, F.lit(at(0))).collect()} == {4, 7}


def test_links_are_shuffled_by_article_alone(spark):
    """Pairs of articles with several sources, by hand; their links used to be dealt by article and entity, then by pair."""
    NOW = datetime(2024, 5, 1)
    rows = [(1, 5, 1, NOW), (1, 5, 2, NOW), (1, 6, 3, NOW), (1, 6, None, NOW), (2, 6, 3, NOW), (2, 5, 2, NOW), (2, None, 2, NOW), (3, 5, None, NOW), (3, 6, 4, NOW), (None, 5, 1, NOW)]
    links = spark.createDataFrame(rows, "article_id long, entity_id long, source_id long, published_at timestamp")
    pairs = graph.article_pairs(links)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(article_id#") == plan.count("Exchange ") == 2
    assert {(r.a, r.b, r.article_id): set(r.s) for r in pairs.collect()} == {(5, 6, 1): {1, 2}, (5, 6, 2): {2}, (5, 6, 3): set()}
    got = [(r.a, r.b, r.n, r.sources) for r in graph.relationships(links, F.lit(NOW)).collect()]
    assert got == [(5, 6, 3, 2)]
