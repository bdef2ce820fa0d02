"""Story assignment against a plain loop over the articles in their order."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest

from storyloom.operators import stories, textsim
from storyloom.plans import stories as plans

START = datetime(2024, 1, 1)
SCHEMA = "article_id long, title string, content string, source string, published_at timestamp"


def plain(rows, names, copies):
    """Every open story is scored for every article."""
    timed = [r for r in rows if r[4] is not None]
    ids = {r[0] for r in timed}
    copies = {a: b for a, b in copies.items() if a in ids}
    while any(b in copies for b in copies.values()):
        copies = {a: copies.get(b, b) for a, b in copies.items()}
    copies = {a: b for a, b in copies.items() if b in ids}
    counts = {i: Counter((c or "").lower().split()) for i, _, c, _, _ in timed if i not in copies}
    df = Counter(w for c in counts.values() for w in c)
    vectors = {}
    for i, c in counts.items():
        v = {w: n * math.log((1 + len(counts)) / (1 + df[w])) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {w: x / size for w, x in v.items()} if size else {}
    held, out = {}, {}
    for i, title, _, _, ts in sorted(timed, key=lambda r: (r[4], r[0])):
        title = (title or "").lower()
        if i in copies:
            key = out[copies[i]]
        else:
            key, best = None, 0.0
            for s in sorted((s for s in held if held[s]["last"] >= ts - timedelta(days=3)), key=lambda s: (-held[s]["last"].timestamp(), s)):
                story, own = held[s], names.get(i, set())
                near = min(1.0, sum(w * vectors[story["newest"]].get(t, 0.0) for t, w in vectors[i].items()))
                either = own | story["names"]
                score = 0.30 * SequenceMatcher(None, title, story["title"]).ratio() + (0.35 * near + 0.35 * (len(own & story["names"]) / len(either) if either else 0.0))
                if score > best and score >= 0.35:
                    key, best = s, score
            if key is None:
                key = i
                held[i] = {"title": title, "names": set(), "last": ts}
            held[key]["newest"] = i
            held[key]["names"] |= names.get(i, set())
        held[key]["last"] = max(held[key]["last"], ts)
        out[i] = key
    return out


def made(n, seed, days, families=40):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghijklm", k=draw.randint(3, 8)))
    common = [word() for _ in range(30)]
    kinds = [([word() for _ in range(6)], [word() for _ in range(25)], [f"e{draw.randrange(60)}" for _ in range(4)]) for _ in range(families)]
    rows, names, copies = [], {}, {}
    for i in range(n):
        title, body, own = kinds[draw.randrange(families)]
        title = [w if draw.random() < 0.7 else word() for w in title]
        body = [draw.choice(body) if draw.random() < 0.5 else draw.choice(common) if draw.random() < 0.8 else word() for _ in range(40)]
        ts = START + timedelta(minutes=draw.randrange(days * 1440) // 5 * 5)
        rows.append((i, " ".join(title), " ".join(body), f"s{draw.randrange(4)}", ts))
        if draw.random() < 0.7:
            names[i] = {e for e in own if draw.random() < 0.6} | ({f"x{draw.randrange(500)}"} if draw.random() < 0.5 else set())
    order = sorted(rows, key=lambda r: (r[4], r[0]))
    for at in draw.sample(range(1, n), n // 8):
        copies[order[at][0]] = order[draw.randrange(max(0, at - 400), at)][0]
    rows += [(n, None, None, None, START), (n + 1, "no time", "a b c", "s0", None), (n + 2, "", "", "s0", START + timedelta(days=days + 30))]
    copies[n + 2] = order[0][0]
    return rows, names, copies


@pytest.mark.parametrize(("n", "seed", "days", "hours"), [(2000, 1, 12, 72), (300, 2, 5, 24)])
def test_equal_to_a_loop(spark, n, seed, days, hours):
    rows, names, copies = made(n, seed, days)
    entities = spark.createDataFrame([(i, e) for i, own in names.items() for e in own] + [(0, None)], "article_id long, name string")
    duplicates = spark.createDataFrame(list(copies.items()), "article_id long, duplicate_of long")
    got = {r.article_id: r.story for r in stories.assign(spark.createDataFrame(rows, SCHEMA), entities, duplicates, hours).collect()}
    want = plain(rows, names, copies)
    assert got == want
    sizes = Counter(want.values())
    assert max(sizes.values()) > 5 and len(sizes) < len(want) * 0.9


def test_boundaries(spark):
    """Hand-written: the three days to the second, the threshold, ties, and a closed story reopened by a duplicate."""
    day = lambda d, s=0: START + timedelta(days=d, seconds=s)
    rows = [
        (1, "aaaa", "red fox", "s", day(0)),
        (2, "aaaa", "red fox", "s", day(3)),  # exactly three days: joins
        (3, "aaaa", "red fox", "s", day(6, 1)),  # a second too late: a story of its own
        (4, "zzzz", "lone word here", "s", day(6, 2)),
        (5, "aaaa", "", "s", day(20)),  # a duplicate of 1 reopens its story
        (6, "aaaa", "red fox", "s", day(21)),
        (7, "qqqq", "other thing", "s", day(21)),
        (8, "qqqq", "nothing alike", "s", day(21, 5)),  # equal titles alone are .30
    ]
    none = spark.createDataFrame([], "article_id long, name string")
    got = stories.assign(spark.createDataFrame(rows, SCHEMA), none, spark.createDataFrame([(5, 1)], "article_id long, duplicate_of long"))
    assert {r.article_id: r.story for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 1, 7: 7, 8: 8}
    names = spark.createDataFrame([(7, "e"), (8, "e")], "article_id long, name string")
    got = stories.assign(spark.createDataFrame(rows, SCHEMA), names, spark.createDataFrame([], "article_id long, duplicate_of long"))
    assert {r.article_id: r.story for r in got.collect()}[8] == 7


def test_query_and_empty(spark, sf):
    none = spark.createDataFrame([], SCHEMA)
    assert stories.assign(none, spark.createDataFrame([], "article_id long, name string"), spark.createDataFrame([], "article_id long, duplicate_of long")).count() == 0
    rows = plans.story_table(spark, sf).collect()
    assert sum(r.articles for r in rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and any(r.articles > 1 for r in rows)
    assert all(r.first_ts <= r.last_ts and r.confirmed == (r.sources >= 2) for r in rows)


def test_small_slices_need_no_links_and_blocks_give_the_same(spark, monkeypatch):
    rows, names, copies = made(120, 3, 10)
    articles = spark.createDataFrame(rows, SCHEMA)
    entities = spark.createDataFrame([(i, n) for i, own in names.items() for n in own], "article_id long, name string")
    same = spark.createDataFrame(list(copies.items()), "article_id long, duplicate_of long")
    assigned = lambda: {r.article_id: r.story for r in stories.assign(articles, entities, same).collect()}
    with monkeypatch.context() as m:
        m.setattr(stories.ordering, "components", None)
        whole = assigned()
    monkeypatch.setattr(stories._step, "__defaults__", (0,))
    assert assigned() == whole == plain(rows, names, copies)


@pytest.mark.parametrize(("n", "seed", "days", "families"), [(1200, 5, 30, 40), (900, 6, 8, 12)])
def test_rounds_over_blocks_equal_a_loop(spark, monkeypatch, n, seed, days, families):
    """However many days, a few rounds over all of them at once; what one article changes reaches the later ones."""
    rows, names, copies = made(n, seed, days, families)
    entities = spark.createDataFrame([(i, e) for i, own in names.items() for e in own], "article_id long, name string")
    same = spark.createDataFrame(list(copies.items()), "article_id long, duplicate_of long")
    monkeypatch.setattr(stories._step, "__defaults__", (0,))
    rounds, components = [], stories.ordering.components
    monkeypatch.setattr(stories.ordering, "components", lambda links: rounds.append(1) or components(links))
    got = {r.article_id: r.story for r in stories.assign(spark.createDataFrame(rows, SCHEMA), entities, same).collect()}
    assert got == plain(rows, names, copies)
    assert 1 <= len(rounds) < days


def test_whole_texts_are_compared(spark):
    """Two texts of equal beginnings, 2000 characters long, that have nothing else in common."""
    opening = "a" * 2000
    rest = lambda k: " ".join(f"w{k}x{i}" for i in range(50))
    rows = [(i, "same title" if i < 2 else f"{i}", f"{opening if i < 2 else ''} {rest(i)}", "s", START + timedelta(minutes=i)) for i in range(6)]
    none = spark.createDataFrame([], "article_id long, name string"), spark.createDataFrame([], "article_id long, duplicate_of long")
    got = {r.article_id: r.story for r in stories.assign(spark.createDataFrame(rows, SCHEMA), *none).collect()}
    assert got == plain(rows, {}, {}) == {i: i for i in range(6)}


def test_only_open_stories_are_held():
    """A block's table is as long as its open stories ask for, however many came before; a duplicate opens one again."""
    draw, held, most = random.Random(4), stories._Open(), 0
    terms = lambda: sorted(draw.sample(range(-5000, 5000), 6))
    row = lambda i, title: type("Row", (), {"id": i, "original": i, "title": title, "ts": i * 3600.0, "terms": np.array(terms()), "weights": np.full(6, 6**-0.5), "names": [f"n{i}"]})
    first = row(0, "the first")
    held.article(first)
    for i in range(1, 3000):
        held.article(row(i, f"title {i}"))
        most = max(most, len(held.keys))
    assert len(held.stories) > 2900 and most < 300
    again = row(3000, "the first")
    again.terms, again.names = first.terms, ["n0"]
    assert held.best(again.title, again.ts, again.terms, again.weights, again.names) == (None, 0.0)
    held.copy(type("Row", (), {"id": 3001, "original": 0, "ts": again.ts}))
    assert held.best(again.title, again.ts, again.terms, again.weights, again.names)[0] == 0


def test_ratio_bound():
    draw = random.Random(9)
    for _ in range(400):
        a, b = ("".join(draw.choices("abcde ", k=draw.randrange(40))) for _ in "ab")
        assert textsim.ratio(a, b) <= textsim.ratio_bound(a, b) + 1e-12 and textsim.ratio_bound(a, a) == 1.0
    assert textsim.ratio_bound("abcd", "dcba") == 0.25
