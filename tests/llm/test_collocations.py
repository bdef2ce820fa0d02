"""Collocations against a plain count of everything."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storyloom.llm import collocations, queries

LOWERED = {c: c + 32 for c in range(65, 91)}


def plain(rows, support=30, top=2000, contained=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWERED)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= support}
    dropped = set()
    for q, a in found.items():
        for k in range(2, len(q) - 1):
            for i in range(1, len(q) - k + 1):
                p = (q[0], *q[i : i + k])
                if 100 * a >= contained * found[p]:
                    dropped.add(p)
    out = []
    for lang in n:
        scored = []
        for p, a in found.items():
            if p[0] == lang and p not in dropped:
                ways = [(f[(lang, *p[1:k])], f[(lang, *p[k:])]) for k in range(2, len(p))]
                score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(ways))
                scored.append((-score, -a, " ".join(p[1:]).encode(), l, r))
        out += [(lang, rank, s[2].decode(), -s[1], s[3], s[4], n[lang], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def got(frame):
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, frame.collect()))


def test_whole_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    found = queries.op11_son_collocations(spark, sf)
    assert {t for _, t in found.dtypes} == {"string", "bigint"}
    want = plain(rows)
    assert want and got(found) == want


@pytest.mark.parametrize("shards", [1, 3, 50])
def test_any_shards_find_all(spark, shards):
    """Phrases spread thinly over shards, one in copies of one text, one in one long text."""
    rows = [(f"thin phrase here. x{i} filler y{i}", "en") for i in range(7)]
    rows += [("a copied text of a copied text", "en")] * 6 + [("deep inside one text, " * 9, "en"), (None, "en"), ("", None), ("Thin PHRASE here; thin\tphrase  here", None)] + [("x y x y x y x y x y", None)] * 2
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("n", "a.b", "shard", "phrase", "words")})
    assert got(collocations.collocations(docs, support=5, shards=shards)) == plain(rows, support=5)
    assert got(collocations.collocations(docs, support=5, shards=shards, top=2)) == plain(rows, support=5, top=2)


def test_text_longer_than_a_run_and_odd_white_space(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_AT_ONCE", 1000)
    rows = [("one two\x1cthree four\x0bfive é è ÀB. " * 300, "fr"), ("one two\x1cthree", "fr"), ("q" * 5000, "fr")] + [(f"short {i % 3}", "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert got(collocations.collocations(docs, support=10)) == plain(rows, support=10)


def test_counts_beyond_one_word_and_empty(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).count() == 0
    frequent, totals = collocations.phrase_counts(spark.createDataFrame([("a a a", "x")], "text string, lang string"), support=2)
    assert {tuple(r) for r in frequent.collect()} == {("x", "a", 3), ("x", "a a", 2)} and totals.collect()[0].n == 3


def test_bitmap_has_every_phrase(spark):
    rows = [("en", s, p) for s in range(3) for p in ("a", "a b", "é c d", "w x y z")]
    bitmap = collocations._bitmap(spark.createDataFrame(rows, "lang string, shard int, phrase string")).value
    assert int(sum(bin(b).count("1") for b in bitmap.tolist())) == len(rows)
