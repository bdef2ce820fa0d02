"""Event resolution against a plain loop over the stories in their order."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

from storyloom.operators import events
from storyloom.plans import stories as plans

START = datetime(2024, 1, 1)
SCHEMA = "story long, title string, type string, place string, first_ts timestamp, last_ts timestamp, importance double"


def plain(rows):
    titles = {(r[1] or "").lower() for r in rows if r[4]}
    df = Counter(w for t in titles for w in set(t.split()))

    def vector(title):
        v = {w: n * math.log((1 + len(titles)) / (1 + df[w])) for w, n in Counter((title or "").lower().split()).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    held, out = {}, {}
    for i, title, kind, place, first, last, _ in sorted((r for r in rows if r[4]), key=lambda r: (r[4], r[0])):
        kind, place, last, own = kind or "unknown", (place or "").lower(), last or first, vector(title)
        best, found = 0.0, None
        for key in sorted((k for k in held if held[k][3] >= first - timedelta(days=5)), key=lambda k: (-held[k][3].timestamp(), k)):
            v, t, p, _ = held[key]
            score = 0.4 * min(1.0, sum(w * v.get(x, 0.0) for x, w in own.items())) + (0.3 if kind != "unknown" and t == kind else 0.0)
            if place and p:
                score += 0.3 if place == p else 0.15 if place in p else 0.0
            if score > best and score >= 0.45 - 1e-12:
                best, found = score, key
        if found is None:
            found = i
            held[i] = [own, kind, place, last]
        held[found][3] = max(held[found][3], last)
        out[i] = found
    return out


def made(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        first = START + timedelta(minutes=draw.randrange(40 * 1440))
        place = draw.choice(["Rome", "Oslo", "York", "New York", "new", "Lima", "", None, "Cairo", "Quito"])
        rows.append((i, " ".join(draw.choices(words, k=draw.randint(1, 4))), draw.choice(["fire", "vote", "unknown", None, "flood", "talks"]), place, first, first + timedelta(hours=draw.randrange(72)) if draw.random() < 0.8 else None, draw.random()))
    return rows + [(n, None, None, None, START, None, None), (n + 1, "w1", "fire", "Rome", None, None, 0.5)]


def test_equal_to_a_loop(spark):
    for seed, n in ((1, 250), (2, 60)):
        rows = made(seed, n)
        got = {r.story: r.event for r in events.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
        want = plain(rows)
        assert got == want and 5 < len(set(want.values())) < n


def test_by_hand(spark):
    at = lambda d, s=0: START + timedelta(days=d, seconds=s)
    rows = [
        (1, "alpha beta", "fire", "New York", at(0), at(1), 0.2),
        (2, "gamma", "fire", "york", at(6), None, 0.4),  # .3 and .15, exactly five days after
        (3, "gamma", "fire", "york", at(11, 1), None, 0.4),  # a second too late
        (4, "alpha beta", "vote", "New York", at(12), None, 0.4),  # no other has the type, and 3 another place
        (5, "alpha beta", "unknown", "new york", at(12, 9), None, 0.4),  # .4 and .3
        (6, "alpha beta", "unknown", "", at(12, 10), None, 0.4),  # .4 alone
    ]
    resolved = events.resolve(spark.createDataFrame(rows, SCHEMA))
    assert {r.story: r.event for r in resolved.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    first = {r.event: (r.first_ts, r.last_ts, r.stories, r.importance) for r in events.refresh(spark.createDataFrame(rows, SCHEMA), resolved).collect()}[1]
    assert first == (at(0), at(6), 2, 0.3)


def test_query_and_none(spark, sf):
    rows = plans.event_table(spark, sf).collect()
    told = plans._told(spark, sf).collect()
    assert sum(r.stories for r in rows) == len(told) and any(r.stories > 1 for r in rows)
    got = {r.story: r.event for r in plans.event_resolution(spark, sf).collect()}
    assert got == plain([tuple(r) for r in told])
    assert events.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_common_words_make_no_pairs_of_titles(spark, monkeypatch):
    """Many titles that share words are linked by stars, not pair by pair."""
    monkeypatch.setattr(events.textsim, "cosine_pairs", None)
    rows = made(3, 120)
    got = {r.story: r.event for r in events.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows)
