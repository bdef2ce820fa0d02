import random

from pyspark.sql import functions as F

from storyloom.operators import dedup
from storyloom.plans import articles as plans


def shingles(text, size=5):
    body = " ".join(text.lower().split())[:2000]
    return {body[i : i + size] for i in range(len(body) - size + 1)}


def test_shingle_pairs_are_all_pairs(spark):
    draw = random.Random(7)
    rows = []
    for base in range(8):
        words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(90)]
        for variant in range(4):
            own = words[:]
            for _ in range(variant * 3):
                own[draw.randrange(90)] = "".join(draw.choices("xyz", k=4))
            rows.append((base * 10 + variant, " ".join(own)))
    rows += [(100, rows[0][1].upper()), (101, "short"), (102, None)]
    df = spark.createDataFrame(rows, "article_id long, content string")
    got = {(r.a, r.b): r.similarity for r in dedup.shingle_pairs(df).collect()}
    want = {}
    for a, s in rows[:32]:
        for b, t in rows[:32]:
            x, y = shingles(s), shingles(t)
            if a < b and len(x & y) >= 0.75 * len(x | y):
                want[a, b] = len(x & y) / len(x | y)
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_every_copy_has_its_class(spark):
    draw = random.Random(8)
    rows, at = [], 0
    for base in range(6):
        words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(90)]
        for variant in range(4):
            own = words[:]
            for _ in range(variant * 4):
                own[draw.randrange(90)] = "".join(draw.choices("xyz", k=4))
            text = " ".join(own)
            for copy in (text, text.upper(), text.replace(" ", "\n "))[: 1 + (base + variant) % 3]:
                rows.append(((at := at + 1) * 7 % 101, copy))
    long = " ".join("".join(draw.choices("ijkl", k=5)) for _ in range(500))
    rows += [(200, long), (201, long + " a further end"), (202, "short"), (203, None), (204, " " * 400)]
    compared = [r for r in rows if r[0] < 202]
    sets = {i: shingles(t) for i, t in compared}
    near = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])} for i in sets}
    want = {}
    for i in sets:
        reached, left = {i}, [i]
        while left:
            left += (new := near[left.pop()] - reached)
            reached |= new
        want[i] = (min(reached), len(near[i]))
    df = spark.createDataFrame(rows, "article_id long, content string")
    members, _ = dedup.shingle_members(df)
    assert {r.article_id: (r.class_id, r.links) for r in members.collect()} == want
    links = dedup.shingle_links(df).collect()
    assert {x for r in links for x in (r.a, r.b)} == {i for i in near if near[i]}
    assert all(r.b in near[r.a] and r.class_id == want[r.a][0] for r in links)


def test_cascade_takes_the_first_stage(spark):
    first = spark.createDataFrame([(2, 1)], "article_id long, duplicate_of long")
    second = spark.createDataFrame([(2, 0), (3, 1)], "article_id long, duplicate_of long")
    got = {r.article_id: (r.duplicate_of, r.stage) for r in dedup.cascade([first, second]).collect()}
    assert got == {2: (1, 1), 3: (1, 2)}


def test_cascade_has_the_shingle_stage(spark, monkeypatch):
    draw = random.Random(9)
    base = " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(150))
    other = " ".join("".join(draw.choices("mnopqrst", k=5)) for _ in range(150))
    # 2 is the earliest; 1 opens with another character, 3 ends otherwise, 4 equals 3 but for its title, 5 equals 2
    rows = [(1, 5, "a", "X" + base[1:]), (2, 1, "a", base), (3, 3, "b", base + " end"), (4, 4, "c", base + " end"), (5, 9, "a", base), (6, 0, "a", other), (7, 2, "a", None)]
    df = spark.createDataFrame(rows, "article_id long, published_at long, title string, content string").withColumn("source", F.lit("s"))
    monkeypatch.setattr(plans.tb, "articles", lambda *_: df)
    got = {r.article_id: (r.duplicate_of, r.stage) for r in plans.cascade_shingles(spark, "").collect()}
    assert got == {5: (2, 1), 3: (2, 2), 4: (2, 2), 1: (2, 3)}
    assert 1 not in {r.article_id for r in plans.cascade(spark, "").collect()}


def test_alike_sets_share_a_signature(spark):
    """Sets of every size, changed as far as the similarity allows: one that is at least 0.75 alike has a common key."""
    import numpy as np

    draw = np.random.default_rng(3)
    sets, alike = [], []
    for size in [*range(1, 40), 55, 90, 200, 431, 700, 1200, 1999]:
        base = draw.integers(-(1 << 62), 1 << 62, 2 * size)
        sets.append(set(base[:size].tolist()))
        for _ in range(3):
            gone, new = draw.integers(0, size // 4 + 1), draw.integers(0, size // 3 + 1)
            other = set(base[gone:size].tolist()) | set(base[size : size + new].tolist())
            if other and len(other) <= 2000 and len(sets[-1 - 0] & other) >= 0.75 * len(sets[-1 - 0] | other):
                alike.append((len(sets) - 1, sets[-1], other))
    rows = [(i, sorted(s)) for i, s in enumerate(sets)] + [(1000 + i, sorted(o)) for i, (_, _, o) in enumerate(alike)]
    keys, need = {}, {}
    for r in dedup.set_signatures(spark.createDataFrame(rows, "id long, grams array<long>"), 0.75, 2000).collect():
        keys.setdefault((r.id, r.pair), set()).add(r.key)
        need[r.id, r.pair] = r.need

    def meet(a, b):
        shared = [p for i, p in keys if i == a and (b, p) in keys]
        return any(len(keys[a, p] & keys[b, p]) >= max(need[a, p], need[b, p]) for p in shared)

    assert len(alike) > 60 and all(meet(1000 + i, at) for i, (at, _, _) in enumerate(alike))
    assert sum(meet(a, b) for a in range(len(sets)) for b in range(a)) < 20


def test_meetings_are_all_shared_keys():
    import numpy as np

    from storyloom.operators import similarity

    draw = np.random.default_rng(5)
    rows = np.unique(draw.integers(0, [40, 60], (900, 2)), axis=0)
    rows = np.concatenate([rows[rows[:, 0] != 7], [[7, k] for k in range(60)]])
    held = {o: set(rows[rows[:, 0] == o, 1].tolist()) for o in range(40)}
    want = {(x, y): len(held[x] & held[y]) for y in held for x in range(y) if held[x] & held[y]}
    for most in (1, 100, 1 << 22):
        blocks = list(similarity.meetings(rows[:, 0], rows[:, 1], most))
        got = [tuple(r) for block in blocks for r in np.stack(block, 1).tolist()]
        assert len(got) == len(want) and {(x, y): n for x, y, n in got} == want and (len(blocks) == 1) == (most > 100)
    assert list(similarity.meetings(rows[:0, 0], rows[:0, 1])) == []


def test_keys_that_all_texts_have_make_no_pairs(spark):
    """Texts that share some keys of a part, but fewer than they need, used to be pairs that were shuffled and counted."""
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(6)
    grid = draw.integers(1, 1 << 32, (300, 30), np.uint32)
    grid[:, :5] = 9
    grid[8, :20] = grid[3, :20]
    ids = np.arange(300) * 7 % 301
    group = pa.table({"id": ids, "need": np.full(300, 8 * dedup.PARTS - 5, np.int32), "keys": [row.tobytes() for row in grid]})
    assert [tuple(r.values()) for r in dedup._met(group).to_pylist()] == [(min(ids[3], ids[8]), max(ids[3], ids[8]))]


def test_sketches_lose_no_pair_and_let_few_through():
    """Sets of one vocabulary, some of them changed copies: all pairs alike enough stay, of the others hardly any."""
    import numpy as np

    draw = np.random.default_rng(8)
    words = draw.integers(-(1 << 62), 1 << 62, 6000)
    sets = []
    for size in [1, 2, 3, 5, 9, 30, 80, 200, 340, 360, 690, 710, 1200, 1700, 1995]:
        for _ in range(4):
            base = draw.permutation(words)
            sets.append(np.sort(base[:size]))
            gone, new = draw.integers(0, size // 7 + 1), draw.integers(0, size // 6 + 1)
            sets.append(np.sort(np.concatenate([base[gone:size], base[size : size + new]])))
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    bits = np.stack([dedup.sketch(s) for s in sets])
    differ = lambda i, j: len(np.setxor1d(sets[i], sets[j], assume_unique=True))
    every = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    assert all(np.bitwise_count(bits[i] ^ bits[j]).sum() <= differ(i, j) for i, j in every)
    alike = {(i, j) for i, j in every if 7 * differ(i, j) <= n[i] + n[j]}
    for tile in ((64, 4096), (7, 11)):
        got = [(x, y) for a, b in dedup.near_sketches(n, bits, n, bits, 0.75, tile) for x, y in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and alike <= set(got) and len(set(got) - alike) < 10
    assert len(alike) > len(sets) + 60


def test_pairs_do_not_depend_on_blocks(spark, monkeypatch):
    """Blocks of a few texts, each held against each other, give what one block gives; no shuffled row is a pair of keys."""
    draw = random.Random(12)
    base = [" ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(70)) for _ in range(30)]
    rows = [(i, f"{base[i % 30][: 330 + draw.randrange(80)]} {draw.randrange(99)}") for i in range(150)]
    df = spark.createDataFrame(rows, "article_id long, content string")
    whole = {tuple(r) for r in dedup.shingle_pairs(df).collect()}
    monkeypatch.setattr(dedup, "BLOCK", 40)
    assert len(whole) > 150 and {tuple(r) for r in dedup.shingle_pairs(df).collect()} == whole
