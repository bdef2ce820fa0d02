import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyloom.functions import scores
from storyloom.functions import text as tx
from storyloom.operators import dedup, early_warning, graph, quality


def one(spark, column, **values):
    names = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).withColumns(names).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Example.ORG/A/b/?utm_source=x&q=1#top", "https://example.org/A/b?q=1"),
        ("http://a.com", "http://a.com/"),
        ("http://a.com/", "http://a.com/"),
        ("http://a.com//?fbclid=1", "http://a.com//"),
        ("http://a.com/a//?UTM_Source=1&q=a%20b&flag", "http://a.com/a?q=a+b&flag="),
        ("", ""),
        ("http://a.com/x?b=2&a=1", "http://a.com/x?b=2&a=1"),
        ("/a/b", "/a/b"),
        ("mailto:x", "mailto:x"),
        ("www.h.org/p/?gclid=1", "www.h.org/p"),
        ("//H.org/p", "//h.org/p"),
        ("?q=1", "/?q=1"),
        ("http:/a", "http:///a"),
        (" http://A.com/p;x=1?q=2", "http://a.com/p;x=1?q=2"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, tx.canonical_url(F.col("u")), u=url) == want


def test_arabic(spark):
    assert one(spark, tx.fold_arabic(F.col("t")), t="أمَّة") == "امه"
    assert one(spark, tx.arabic_share(F.col("t")), t="ab") == 0 and one(spark, tx.arabic_share(F.col("t")), t="اب") == 1


@pytest.mark.parametrize("n, want", [(0, 0.0), (49, 0.0), (50, 0.2), (99, 0.2), (100, 0.5), (299, 0.5), (300, 0.8), (799, 0.8), (800, 1.0)])
def test_length_ladder(spark, n, want):
    assert one(spark, scores.length_score(F.col("t")), t="x" * n) == want


@pytest.mark.parametrize("d, want", [(1.99, "low"), (2.0, "medium"), (3.0, "high"), (4.0, "critical")])
def test_severity(spark, d, want):
    assert one(spark, scores.severity(F.col("d")), d=d) == want


def test_clean_and_slug(spark):
    assert one(spark, tx.clean(F.col("t")), t=" a \n\t b ") == "a b" and one(spark, tx.clean(F.lit(None).cast("string"))) == ""
    assert one(spark, tx.slug(F.col("t")), t="  Hello, World! ") == "hello-world"


def test_haversine(spark):
    got = one(spark, scores.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert got == pytest.approx(6371 * 3.141592653589793 / 2)


@pytest.mark.parametrize("recent, earlier, want", [(3, 0, 0.6), (9, 0, 1.0), (9, 9, 0.9), (6, 9, 0.7), (9, 18, 0.5), (3, 9, 0.3), (2, 9, 0.1), (0, 9, 0.1)])
def test_velocity_ladder(spark, recent, earlier, want):
    now = datetime(2024, 1, 2)
    rows = [("k", now - timedelta(hours=1))] * recent + [("k", now - timedelta(hours=12))] * earlier
    got = early_warning.velocity(spark.createDataFrame(rows, "key string, ts timestamp"), "key", F.lit(now)).collect()
    assert [r.velocity for r in got] == [want]


def test_influence_by_hand(spark):
    now = datetime(2024, 1, 31)
    # e1: five mentions today from two sources; e2: two mentions ten days ago
    rows = [(i, 1, i % 2, now - timedelta(hours=2)) for i in range(5)] + [(i, 2, 7, now - timedelta(days=10)) for i in range(2)]
    links = spark.createDataFrame(rows, "article_id long, entity_id long, source_id long, published_at timestamp")
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25)], "a long, b long, strength double")
    got = {r.entity_id: r for r in graph.influence(links, edges, F.lit(now)).collect()}
    assert (got[1].d1, got[1].d7, got[1].degree, got[1].growing) == (5, 5, 0.75, True)
    assert got[1].influence == pytest.approx(0.40 + 0.35 + 0.25 * 2 / 3, abs=1e-5)
    assert (got[2].prior7, got[2].growing) == (2, False) and got[2].influence == pytest.approx(0.40 * 0.5 / 0.75 + 0.25 / 3, abs=1e-5)


def test_relationship_confidence_by_hand(spark):
    now = datetime(2024, 1, 31)
    rows = [(i, e, i % 2, now) for i in range(4) for e in (1, 2)] + [(9, 5, s, now) for s in (2, 3)]
    links = spark.createDataFrame(rows, "article_id long, entity_id long, source_id long, published_at timestamp")
    row = graph.relationships(links, F.lit(now)).first()
    assert (row.n, row.sources) == (4, 2) and row.confidence == pytest.approx(4 / 8 + 0.15 * 2 / 4)
    assert row.strength == pytest.approx(0.4 * math.log(5) / math.log(101) + 0.2 + 0.25 * 0.5 + 0.15 * 0.75, abs=1e-6)


@pytest.mark.parametrize(
    "text, language, want",
    [("Subscribe NOW, click here to order today", "en", 0.2), ("click here", "en", 1.0), ("Click  here to read", "en", 0.6), ("subscribe now", "ar", 1.0), ("تابعنا على", "ar", 0.6)],
)
def test_boilerplate(spark, text, language, want):
    assert one(spark, scores.boilerplate_score(F.col("t"), F.col("l") == "ar"), t=text, l=language) == want


@pytest.mark.parametrize("text, want", [("123", 0.5), ("ÀÉÎ a", 0.1), ("ÀÉ abc", 1.0)])
def test_caps_count_every_script(spark, text, want):
    assert one(spark, scores.caps_score(F.col("t")), t=text) == want


@pytest.mark.parametrize("value, want", [(0.125, 0.12), (0.135, 0.14), (0.575, 0.58), (-1.0, 0.0), (2.0, 1.0), (None, 0.0)])
def test_safe_decimal(spark, value, want):
    assert one(spark, scores.safe_decimal(F.col("v").cast("double")), v=value) == want


def test_half_even_is_that_of_fractions(spark):
    from decimal import ROUND_HALF_EVEN, Decimal

    values = [k / 8000 - 1.5 for k in range(24000)] + [0.005, 0.015, -0.005, 1e6 + 0.125, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", scores.half_even(F.col("v")).alias("x"), scores.half_even(F.col("v"), 4).alias("y")).collect()
    for r in got:
        for x, step in ((r.x, "0.01"), (r.y, "0.0001")):
            assert x == (None if r.v is None else float(Decimal(str(round(r.v, 6))).quantize(Decimal(step), ROUND_HALF_EVEN)))


def test_texts_are_scored_and_hashed_once(spark):
    """A filter on the quality doesn't write its scores out again and again, and a key isn't made for each of its uses."""
    texts = ["ÀÉ abc", "", None, "a b c d e " * 9, "Subscribe now, click here to", "ÀÉ abc"]
    rows = spark.createDataFrame([(i, "title", t, "en", i) for i, t in enumerate(texts)], "article_id long, title string, content string, language string, published_at long")
    plan = quality.quality(rows).where("quality >= 0.9").select("article_id", "quality")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("subscribe") <= 2 and plan.count("p{Lu}") <= 2 and plan.count("array_distinct") <= 2  # in the filter and in what it keeps
    same = dedup.exact(rows)
    assert "sha2" not in same._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.article_id, r.duplicate_of) for r in same.collect()} == {(2, 1), (5, 0)}


@pytest.mark.parametrize("link", ["../c", "./c", "a/../b", "/x/../y", "../../../z", ".", "..", "c/./d//e?q=../r", "/../y#./z", "a//b", "/a//b", "c/..", "x/../../y/"])
def test_absolute_url_follows_dots(spark, link):
    from urllib.parse import urljoin

    for base in ("http://h/a/b?x#y", "http://h", "http://h/a/b/c/", "http://h/a/../b/c"):
        assert one(spark, tx.absolute_url(F.col("b"), F.col("l")), b=base, l=link) == urljoin(base, link)


@pytest.mark.parametrize("link, want", [("", ""), ("mailto:q", "mailto:q"), ("//o/p", "http://o/p"), ("/r", "http://h/r"), ("?z", "http://h/a/b?z"), ("#f", "http://h/a/b?x#f"), ("c", "http://h/a/c")])
def test_absolute_url(spark, link, want):
    assert one(spark, tx.absolute_url(F.col("b"), F.col("l")), b="http://h/a/b?x#y", l=link) == want


def test_urls_of_one_host_and_path(spark):
    urls = ["http://www.A.org/P/x/", "https://a.org/p/X?q=1", "/p/x", "mailto:me", "http://a.org/", "http://a.org", "mailto:you", None, "/P/x/"]
    rows = spark.createDataFrame([(i, 0, u) for i, u in enumerate(urls)], "article_id long, published_at int, url string")
    assert {(r.article_id, r.duplicate_of) for r in dedup.by_url(rows).collect()} == {(1, 0), (8, 2)}


def test_html_and_arabic_key(spark):
    html = "<p>a&amp;b</p><script>x < y</script><!-- no --><b>c</b>"
    assert one(spark, tx.html_to_text(F.col("h")), h=html) == "a&b c"
    assert one(spark, tx.arabic_key(F.col("t")), t="أمريكـا") == one(spark, tx.arabic_key(F.col("t")), t="امريكا")


def test_overlaps_that_cannot_reach_the_least_are_not_shuffled(spark):
    """Of large sets only candidates leave the task that counts a part; those used to be all pairs with a common member."""
    import random

    from storyloom.operators import similarity

    draw = random.Random(2)
    sets = {k: set(draw.sample(range(6000), 300)) for k in range(30)}
    sets[40] = set(sorted(sets[3])[:200]) | set(range(7000, 7100))
    sets |= {50: {9001, 9002}, 51: {9002}, 52: {1}}
    rows = [(k, m) for k, s in sets.items() for m in s] + [(3, None), (None, 1), (50, 9001)]
    df = spark.createDataFrame(rows, "owner long, member long")
    got = {(r.a, r.b): (r.common, r.score) for r in similarity.overlap(df, "owner", "member", least=0.3).collect()}
    want = {(a, b): (len(x & y), round(len(x & y) / len(x | y), 6)) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 0.3 * len(x | y)}
    assert got == want and {(3, 40), (50, 51)} <= want.keys()
    sized = df.dropna().distinct().join(spark.createDataFrame([(k, len(s)) for k, s in sets.items()], "owner long, size long"), "owner")
    assert want.keys() <= {(r.a, r.b) for r in similarity._candidates(sized, 0.3).collect()} and similarity._candidates(sized, 0.3).count() < 435 / 2


def test_contexts_are_counted_once_for_both_directions(spark):
    from storyloom.operators import similarity

    df = spark.createDataFrame([(1, 7), (1, 8), (1, 9), (2, 7), (2, 8), (2, 8), (3, 9), (4, 5)], "owner long, member long")
    out = similarity.context(df, "owner", "member")
    assert "(a#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "RepartitionByExpression [a#" in plan and " < " in plan
    got = {(r.a, r.b): (r.shared, r.score) for r in out.collect()}
    assert got == {(1, 2): (2, 0.85), (2, 1): (2, 0.85), (1, 3): (1, 0.733333), (3, 1): (1, 0.85)}


def test_a_part_is_dealt_by_owners_if_it_is_large(spark, monkeypatch):
    """Candidates are the same however many blocks of owners there are, and each pair is counted in one task."""
    import random

    from storyloom.operators import similarity

    draw = random.Random(3)
    sets = {f"o{k}": set(draw.sample(range(400), draw.randrange(1, 60))) for k in range(60)}
    df = spark.createDataFrame([(k, m) for k, s in sets.items() for m in s], "owner string, member long")
    sized = df.join(spark.createDataFrame([(k, len(s)) for k, s in sets.items()], "owner string, size long"), "owner")
    one = {tuple(r) for r in similarity._candidates(sized, 0.15).collect()}
    monkeypatch.setattr(similarity, "MOST", 15)
    monkeypatch.setattr(similarity, "PARTS", 32)
    assert {tuple(r) for r in similarity._candidates(sized, 0.15, df.count()).collect()} == one and len(one) > 50
    got = {(r.a, r.b): r.common for r in similarity.overlap(df, "owner", "member", least=0.15).collect()}
    assert got == {(a, b): len(x & y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 0.15 * len(x | y)}
