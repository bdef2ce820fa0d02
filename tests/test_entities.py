"""Grouping of names and surname merges, by hand and against a loop."""

import random

from storyloom.operators import entities

SCHEMA = "article_id long, position int, name string, kind string, display string, mentions long, snippet string"


def plain(rows):
    out = []
    for article in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == article), key=lambda r: (-len((r[2] or "").lower().split()), r[1]))
        tokens = [set((r[2] or "").lower().split()) for r in own]
        root = list(range(len(own)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                if own[i][3] == own[j][3] == "person" and tokens[j] and tokens[j] <= tokens[i]:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        for i, r in enumerate(own):
            if find(i) == i:
                members = [own[j] for j in range(len(own)) if find(j) == i]
                aliases = sorted({m[4] for m in members if m[4].lower() != r[4].lower()})
                out.append((article, r[2], r[3], r[4], sum(m[5] for m in members), tuple(aliases), max((m[6] or "" for m in members), key=len)))
    return sorted(out, key=str)


def test_groups_are_those_of_a_loop(spark):
    draw = random.Random(4)
    rows = []
    for article in range(60):
        for position in range(draw.randint(1, 9)):
            name = " ".join(draw.choices("anna bo chen dee eli".split(), k=draw.randint(1, 4)))
            rows.append((article, position, name, draw.choice(["person"] * 5 + ["place"]), draw.choice([name, name.title()]), draw.randrange(5), "s" * draw.randrange(4)))
    rows += [(99, 0, "", "person", "", 1, None), (99, 1, " ", "person", " ", 1, None)]
    got = [(*r[:5], tuple(r.aliases), r.snippet) for r in entities.group_names(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_short_articles_are_grouped_without_joins(spark, monkeypatch):
    """Only articles of more than AT_ONCE names go through joins; a missing article's names aren't compared."""
    draw = random.Random(5)
    short = [(a, p, " ".join(draw.choices("anna bo chen dee".split(), k=draw.randint(1, 3))), "person", draw.choice(["X", "x", "y"]), 1, None) for a in range(20) for p in range(draw.randint(1, entities.AT_ONCE))]
    short += [(30, p, f"anna w{p}", "person", None, 2, "s") for p in range(entities.AT_ONCE)]
    joined, by_joins = [], entities._by_joins
    monkeypatch.setattr(entities, "_by_joins", lambda rows: joined.append({r.article_id for r in rows.collect()}) or by_joins(rows))
    got = entities.group_names(spark.createDataFrame(short, SCHEMA)).collect()
    assert not joined and len(got) < len(short)
    long = [(40, p, draw.choice(["anna", "bo", f"anna w{p}", f"bo w{p % 7} x"]), "person", f"D{p}", p, "s" * (p % 5)) for p in range(entities.AT_ONCE + 9)]
    rows = [r for r in short if r[4]] + long
    got = [(*r[:5], tuple(r.aliases), r.snippet) for r in entities.group_names(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == plain(rows) and joined == [{40}]
    for n in (2, entities.AT_ONCE + 1):
        missing = [(None, p, "anna", "person", "Anna", 1, "") for p in range(n)]
        assert entities.group_names(spark.createDataFrame(missing, SCHEMA)).count() == n


def test_surnames(spark):
    persons = [(1, "Ann Lee", 5), (2, "lee", 10), (3, "Bo Lee", 5), (4, "Chen", 3), (5, "Dee Chen", 1), (6, "Eli", 1), (7, "", 1), (8, None, 1), (9, "Lee", 11)]
    merges = entities.surname_merges(spark.createDataFrame(persons, "entity_id long, name string, articles long"))
    assert {(r.entity_id, r.into) for r in merges.collect()} == {(2, 1)}  # 9 has over twice as many as 1, 4 over twice as many as 5
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 2, 4), (3, 6, 1)], "article_id long, entity_id long, mentions long")
    assert {tuple(r) for r in entities.merge_into(links, merges).collect()} == {(1, 1, 5), (2, 1, 4), (3, 6, 1)}
