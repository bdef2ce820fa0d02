"""Title and near duplicates, and the joins below them, against all pairs."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from storyloom.operators import dedup, ordering, textsim
from storyloom.plans import articles as plans

START = datetime(2024, 1, 1)


def made(seed=3, n=160):
    """Articles over twelve days: families of edited titles and contents, copies, missing parts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(2, 8)))
    families = [([word() for _ in range(8)], [word() for _ in range(60)]) for _ in range(12)]
    rows = []
    for i in range(n):
        title, body = map(list, families[draw.randrange(12)])
        for _ in range(draw.choice([0, 0, 0, 1, 1, 3])):
            title[draw.randrange(8)] = word()
        for _ in range(draw.choice([0, 0, 5, 15, 22, 30])):
            body[draw.randrange(60)] = word()
        t = " ".join(title)
        if draw.random() < 0.4:
            at = draw.randrange(len(t))
            t = t[:at] + "x" + t[at + 1 :]
        rows.append((i, t, " ".join(body), f"s{draw.randrange(3)}", START + timedelta(minutes=draw.randrange(12 * 24 * 60) if draw.random() < 0.6 else 60 * draw.randrange(40))))
    rows += [(n, None, "a b", "s0", START), (n + 1, "", "a b", "s0", START), (n + 2, "t", "", None, None), (n + 3, rows[0][1].upper(), rows[0][2], None, rows[0][4]), (n + 4, rows[0][1], rows[0][2], None, rows[0][4] + timedelta(hours=1))]
    return rows


SCHEMA = "article_id long, title string, content string, source string, published_at timestamp"


def vectors(rows):
    classes = {(t.lower(), (c or "").lower()[:2000]) for _, t, c, _, when in rows if t and when}
    counts = {k: Counter(k[1].split()) for k in classes}
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for k, c in counts.items():
        v = {w: n * math.log((1 + len(classes)) / (1 + df[w])) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out[k] = {w: x / size for w, x in v.items()} if size else {}
    return out


def newest(rows, passes):
    out = {}
    for i, t, c, s, when in rows:
        earlier = [(w, j, x) for j, *x, w in rows if t and x[0] and when and w and (w, j) < (when, i) and when - w <= timedelta(days=7)]
        found = [(w, j) for w, j, x in earlier if passes((t.lower(), (c or "").lower(), s), (x[0].lower(), (x[1] or "").lower(), x[2]), (when - w).total_seconds() / 3600)]
        if found:
            out[i] = max(found)[1]
    return out


def test_near_titles_are_all_pairs(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    for threshold in (0.96, 0.9):
        want = newest(rows, lambda a, b, _: SequenceMatcher(None, a[0], b[0]).ratio() >= threshold)
        assert {r.article_id: r.duplicate_of for r in dedup.titles(df, threshold).collect()} == want and len(want) > 50
    with pytest.raises(ValueError):
        dedup.titles(df, 0.7)


def test_near_duplicates_are_all_pairs(spark):
    rows = made(4)
    held = vectors(rows)

    def passes(a, b, hours):
        ratio = SequenceMatcher(None, a[0], b[0]).ratio()
        if ratio < 0.65:
            return False
        boost = 0.10 if hours <= 2 else 0.07 if hours <= 6 else 0.05 if hours <= 12 else 0.03 if hours <= 24 else 0.0
        x, y = held[a[:2]], held[b[:2]]
        cosine = sum(w * y.get(t, 0.0) for t, w in x.items())
        return cosine >= 0.75 - boost - (0.04 if ratio >= 0.85 else 0.0) - (0.02 if (a[2] or "") == (b[2] or "") else 0.0)

    want = newest(rows, passes)
    got = {r.article_id: r.duplicate_of for r in dedup.near(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and len(want) > 40


def test_cosine_candidates_lose_nothing(spark):
    rows = made(5)
    classes = spark.createDataFrame([(i, c) for i, _, c, _, _ in rows], "id long, body string")
    held = textsim.term_vectors(classes)
    listed = {r.id: dict(zip(r.terms, r.weights)) for r in held.collect()}
    for threshold in (1 / 7, 0.59):
        times = spark.createDataFrame([(i, START) for i in listed], "id long, ts timestamp")
        got = {(r.a, r.b) for r in textsim.cosine_pairs(textsim.near(24, times, textsim.heads(held, threshold), "term"), held, threshold).collect()}
        assert got == {(a, b) for a in listed for b in listed if a < b and sum(w * listed[b].get(t, 0) for t, w in listed[a].items()) >= threshold - 1e-9}


def test_latest_before(spark):
    at = lambda h: START + timedelta(hours=h)
    posts = spark.createDataFrame([("k", at(0), 1), ("k", at(0), 2), ("k", at(30), 3), ("j", at(1), 4)], "key string, ts timestamp, id long")
    asks = [("k", at(0), 1, "first"), ("k", at(0), 2, "tie"), ("k", at(24), 9, "edge"), ("k", at(25), 9, "far"), ("k", at(31), 0, "next"), ("j", at(0), 9, "none"), ("x", at(5), 9, "no key")]
    got = {r.note: r.found and r.found.id for r in ordering.latest_before(posts, spark.createDataFrame(asks, "key string, ts timestamp, id long, note string"), 24 * 3600).collect()}
    assert got == {"first": None, "tie": 1, "edge": 2, "far": None, "next": 3, "none": None, "no key": None}


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (8, 9)], "a long, b long")
    assert {(r.node, r.root) for r in ordering.components(links).collect()} == {(5, 3), (4, 3), (3, 3), (9, 8), (8, 8)}


def test_components_of_a_long_chain(spark, monkeypatch):
    """Links are put together within the ranges of a task first, so a chain takes a few rounds, each of which writes twice."""
    links = spark.createDataFrame([(k + 1, k) for k in range(5, 3000)] + [(9000, 9001)], "a long, b long")
    writes, written = [], ordering.tb.written
    monkeypatch.setattr(ordering.tb, "written", lambda df: writes.append(1) or written(df))
    assert {(r.node, r.root) for r in ordering.components(links).collect()} == {(k, 5) for k in range(5, 3001)} | {(9000, 9000), (9001, 9000)}
    assert len(writes) <= 10


def test_cascade_takes_the_first_stage(spark, sf):
    got = {r.article_id: (r.duplicate_of, r.stage) for r in plans.cascade_titles(spark, sf).collect()}
    by_stage = Counter(stage for _, stage in got.values())
    assert set(by_stage) <= {1, 3, 4, 5} and by_stage[1] > 0 and all(a != d for a, (d, _) in got.items())


def test_no_articles(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dedup.titles(none).count() == 0 and dedup.near(none).count() == 0


def test_stretches_meet_once(spark):
    """Rows of many parts meet in one group if they are near enough in time, and none is compared with all."""
    draw = random.Random(1)
    rows = [(i, draw.randrange(40 * 3600) * 1_000_000) for i in range(400)]
    dealt = ordering.stretches(spark.createDataFrame(rows, "id long, at long"), 3600 * 4, most=30)
    groups = {}
    for r in dealt.collect():
        groups.setdefault((r.stretch, r.i, r.j), []).append(r)
    met = Counter((x.id, y.id) for g in groups.values() for x in g if x.asks for y in g if y.posts)
    near = {(x, y) for x, at in rows for y, before in rows if 0 <= at - before <= 4 * 3600 * 1_000_000}
    assert near <= set(met) and set(met.values()) == {1} and max(map(len, groups.values())) < 120
    assert max(map(len, groups.values())) < len(rows) / 3


def test_bounds_lose_nothing():
    titles = sorted({t for _, t, *_ in made(6) if t})
    held = textsim.Ratios(titles, 0.65)
    able = held.able(np.arange(len(titles)), slice(0, len(titles)))
    assert all(able[x, y] for x in range(len(titles)) for y in range(len(titles)) if held(x, y) >= 0.65) and not able.all()
    draw = np.random.default_rng(2)
    terms = [np.unique(draw.integers(-50, 50, 30)) for _ in range(40)]
    weights = [(w := draw.random(len(t))) / np.sqrt(w @ w) for t in terms]
    cosines = textsim.Cosines(pa.chunked_array([pa.array(terms, pa.list_(pa.int64()))]), pa.chunked_array([pa.array(weights, pa.list_(pa.float64()))]), buckets=16)
    able = cosines.able(np.arange(40), slice(5, 40), 0.4)
    assert all(able[x, y - 5] for x in range(40) for y in range(5, 40) if cosines(x, y) >= 0.4)


def test_titles_without_a_row_for_each_pair(spark):
    """The plan has no join of titles with each other: its rows are the articles, not their pairs."""
    plan = dedup.titles(spark.createDataFrame(made(), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "FlatMapGroupsInArrow" in plan


def test_terms_are_counted_by_parts(spark):
    """A part's terms stand once in its first row, whatever texts have them; rows hold small places."""
    words = [[7, 7, 9], [9], None, []] + [[9, i % 3] for i in range(2 * textsim.PART)]
    made = list(textsim._counts([pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["id", "words"])]))
    assert [b.num_rows for b in made] == [textsim.PART, textsim.PART, 4]
    for batch in made:
        first, *others = batch.to_pylist()
        assert not any(r["terms"] or r["texts"] for r in others)
        for row in (first, *others):
            given = words[row["id"]] or []
            assert {first["terms"][p]: n for p, n in zip(row["places"], row["counts"])} == Counter(given) and row["part"] == first["id"]
        assert dict(zip(first["terms"], first["texts"])) == Counter(w for r in batch.to_pylist() for w in set(words[r["id"]] or []))
    texts = [(i, " ".join(f"w{j}" for j in range(i % 7)) + (" w1" if i % 2 else "")) for i in range(50)]
    got = {r.id: r.weights for r in textsim.term_vectors(spark.createDataFrame(texts, "id long, body string").repartition(3)).collect()}
    df = Counter(w for _, t in texts for w in set(t.split()))
    for i, t in texts:
        own = [n * math.log((1 + len(texts)) / (1 + df[w])) for w, n in Counter(t.split()).items()]
        assert (i in got) == bool(own)
        if own:
            assert sorted(got[i]) == pytest.approx(sorted(x / math.sqrt(sum(y * y for y in own)) for x in own), abs=1e-12)
