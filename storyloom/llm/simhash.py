"""SimHash near-duplicates, found through deletion variants.

Fingerprints that differ in at most k bits are cut into k // 2 + 1 segments (two at least); one segment then
differs by one bit at most. Every segment is indexed once for each of its bits with that bit left out, so two
such fingerprints meet under at least one key of a plain equality join; the whole distance is verified there
by bit_count. Equal fingerprints are collapsed first. A segment's variants share its other bits, so what is
shuffled is one row for each quarter of a segment; the variants are made behind the shuffle, and only keys
that two fingerprints have go on to the join.

A key that many different fingerprints have gives a spanning forest of its links, so copies never multiply.
One of very many is first cut by pieces of the remaining bits, one of which must be equal, and what is crowded
even then is dealt into tiles of bounded size, so no task holds a whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm._common import cut, quoted, rows, space_words, texts
from storyloom.llm.components import components

#: A key of more different fingerprints than this gives a spanning forest of its links instead of its pairs.
RUN = 8
#: Fingerprints of one side of a tile; a key of more of them is cut further first.
TILE = 2048
#: Classes of more texts than this are searched by centres first.
LARGE = 64


def shingle_digests(words: list[bytes], size: int, seed: int = 42) -> list[bytes]:
    """XXH64 digests of the space-joined shingles, repeats included; fewer words give the whole sequence."""
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_digest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[min(size, len(words)) - 1 :])]


def _signs(digests: list[bytes]) -> int:
    """Bits set in over half the digests, as a signed 64-bit number."""
    if not digests:
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(digests), 65536):
        total += np.unpackbits(np.frombuffer(b"".join(digests[at : at + 65536]), np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(total > len(digests) / 2).tobytes(), "big", signed=True)


def _with_fingerprints(docs: DataFrame, text: str, make: Callable[[pa.Array], pa.Array], batch_rows: int) -> DataFrame:
    """docs without the text, with `fps`: an array of 64-bit fingerprints."""
    kept = [c for c in docs.columns if c != text]
    packed = docs.select(*[quoted(docs, c) for c in kept], quoted(docs, text).alias("__text"))
    schema = docs.select(*[quoted(docs, c) for c in kept]).schema.add("fps", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, batch_rows):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], make(batch.column(len(kept)))], names=[*kept, "fps"])

    return packed.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """docs without the text, with `fps`: one 64-bit fingerprint over the shingles. Null and empty texts have fingerprint 0."""

    def make(column: pa.Array) -> pa.Array:
        return pa.array([[_signs(shingle_digests(space_words(t), shingle))] for t in texts(column)], pa.list_(pa.int64()))

    return _with_fingerprints(docs, text, make, 2000)


def _mixed(hashes: np.ndarray, view: int) -> np.ndarray:
    """Another independent-looking hash for each view, made from one (the finaliser of SplitMix64)."""
    x = hashes + np.uint64((view * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_bits(hashes: np.ndarray, views: int) -> np.ndarray:
    return np.concatenate([np.unpackbits(_mixed(hashes, v).view(np.uint8).reshape(-1, 8), axis=1) for v in range(views)], 1).astype(np.float32)


def word_fingerprints(docs: DataFrame, text: str = "text", views: int = 4, power: float = 0.5) -> DataFrame:
    """docs without the text, with `fps`: `views` fingerprints over the words, a word found n times weighing n ** power.

    Equal word lists have equal fingerprints; without words they are 0.
    """

    def make(column: pa.Array) -> pa.Array:
        split = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
        order = np.argsort(hashes, kind="stable")  # the order of addition is the text's own, whatever else is in the batch
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes, full = hashes[order], np.array([len(words[i]) > 0 for i in order], bool)
        place = rank[coded.indices.to_numpy()]
        owner = np.repeat(np.arange(len(column)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        owner, place = owner[full[place]], place[full[place]]
        pairs, counts = np.unique(owner * len(words) + place, return_counts=True)
        owner, place, weights = pairs // max(1, len(words)), pairs % max(1, len(words)), (counts**power).astype(np.float32)
        ends = np.searchsorted(owner, np.arange(len(column) + 1))
        table = _word_bits(hashes, views) if len(hashes) <= 60_000 else None
        out = np.zeros((len(column), views), ">i8")
        for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            total = np.zeros(64 * views, np.float32)
            for at in range(a, b, 8192):
                own = place[at : min(b, at + 8192)]
                total += weights[at : at + len(own)] @ (table[own] if table is not None else _word_bits(hashes[own], views))
            out[i] = np.packbits(total > weights[a:b].sum() / 2).view(">i8")
        offsets = np.arange(len(column) + 1, dtype=np.int32) * views
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.astype(np.int64).ravel()))

    return _with_fingerprints(docs, text, make, 500)


def _forest(fps: np.ndarray, most: int) -> np.ndarray:
    """Links of a spanning forest over different fingerprints at most `most` bits apart, nearest first."""
    label, links = np.arange(len(fps)), []
    for i in range(0, len(fps), 512):
        bits = np.bitwise_count(fps[i : i + 512, None] ^ fps[None])
        for distance in range(1, most + 1):
            a, b = np.nonzero(bits == distance)
            a = a + i
            while (apart := label[a] != label[b]).any():  # one link for each two trees that it joins
                a, b = a[apart], b[apart]
                _, first = np.unique(np.stack([label[a], label[b]], 1), axis=0, return_index=True)
                heads = {}

                def head(x: int, heads: dict[int, int] = heads) -> int:
                    while x in heads:
                        x = heads[x]
                    return x

                for k in first.tolist():
                    x, y = head(int(label[a[k]])), head(int(label[b[k]]))
                    if x != y:
                        heads[max(x, y)] = min(x, y)
                        links.append((fps[a[k]], fps[b[k]]))
                moved = np.arange(len(fps))
                for x in heads:
                    moved[x] = head(x)
                label = moved[label]
    return np.array(links, np.uint64).reshape(-1, 2)


def _near(met: DataFrame, key: list[str], most: int) -> DataFrame:
    """(key, u, v): the pairs that share a key and are at most `most` bits apart; a pair may come under several keys."""
    left, right = (met.select(*key, F.col("fp").alias(n)) for n in "uv")
    return left.join(right, key).where(F.expr(f"u < v AND bit_count(u ^ v) <= {most}")).select("key", "u", "v")


def _sized(met: DataFrame, key: list[str]) -> DataFrame:
    return met.withColumn("n", F.count("*").over(Window.partitionBy(*key))).where("n > 1")


def _forests(crowded: DataFrame, by: list[str], most: int) -> DataFrame:
    """(key, u, v): a spanning forest of the links of each group of rows (key, fp); a group is what a task holds."""

    def run(group: pa.Table) -> pa.Table:
        u, v = _forest(np.sort(group["fp"].to_numpy().view(np.uint64)), most).view(np.int64).T
        own = pa.array(np.repeat(group["key"].to_numpy()[:1], len(u)))
        return pa.table([own, pa.array(np.ascontiguousarray(u)), pa.array(np.ascontiguousarray(v))], names=["key", "u", "v"])

    return crowded.groupBy(*by).applyInArrow(run, "key bigint, u bigint, v bigint")


def _tiled(crowded: DataFrame, key: list[str], most: int) -> DataFrame:
    """(key, u, v): spanning forests of the links of each key, by tiles of two of its buckets each."""
    dealt = crowded.withColumn("sides", F.ceil(F.col("n") / TILE).cast("int")).withColumn("side", F.expr("cast(pmod(xxhash64(fp), sides) AS int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, sides - 1)")))
    tiles = dealt.select("fp", *key, F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    return _forests(tiles, [*key, "low", "high"], most)


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(view, u, v): links between different fingerprints (column `fp`) of one view, at most `most` bits apart.

    A column `view` (a small number) tells kinds of fingerprints apart; without it all are of view 0. Every
    pair is there once, but for crowded keys: there a spanning forest of the links, so that connected
    fingerprints stay connected. Nulls are left out; repeated fingerprints count once.
    """
    segments = max(2, most // 2 + 1)
    width = 64 // segments
    if 64 % (4 * segments):
        raise ValueError("the number of segments, most // 2 + 1, must divide 16")
    quarter = width // 4
    segment = f"(shiftrightunsigned(fp, {width} * (p div 4)) & {(1 << width) - 1}L)"
    view = F.col("view").cast("int") if "view" in fps.columns else F.lit(0)
    distinct = fps.select(view.alias("view"), "fp").where("fp IS NOT NULL").distinct()
    rest = distinct.select("view", "fp", F.explode(F.expr(f"sequence(0, {4 * segments - 1})")).alias("p"))
    rest = rest.withColumn("rest", F.expr(f"{segment} & ~shiftleft({(1 << quarter) - 1}L, {quarter} * (p % 4)) | shiftleft(cast(view * {4 * segments} + p AS bigint), 32)")).repartition("rest")
    variants = rest.withColumn("j", F.explode(F.expr(f"sequence(0, {quarter - 1})"))).select(
        "rest", "fp", F.expr(f"{segment} & ~shiftleft(1L, {quarter} * (p % 4) + j) | shiftleft(cast(view * 64 + p * {quarter} + j AS bigint), 32)").alias("key")
    )
    met = cut(_sized(variants, ["rest", "key"]).select("key", "fp", "n"))
    found = _near(met.where(f"n <= {RUN}"), ["key"], most)
    found = found.unionByName(_forests(met.where(f"n > {RUN} AND n <= {TILE}").select("key", "fp"), ["key"], most))
    crowded = met.where(f"n > {TILE}")
    kind = F.expr("cast(shiftrightunsigned(key, 38) AS int)").alias("view")
    if crowded.isEmpty():
        return found.select(kind, "u", "v").distinct()
    # Of the bits outside the key's segment, most + 1 pieces, one of which two linked fingerprints have in common.
    size = (64 - width) // (most + 1)
    at = f"({width} * ((shiftrightunsigned(key, 32) % 64) div {width} + 1))"
    others = F.expr(f"if({at} = 64, fp & {(1 << (64 - width)) - 1}L, shiftrightunsigned(fp, cast({at} AS int)) | shiftleft(fp, cast(64 - {at} AS int)))")
    pieces = crowded.select("key", "fp", others.alias("others")).withColumn("piece", F.explode(F.expr(f"sequence(0, {most})")))
    pieces = pieces.select("key", "fp", "piece", F.expr(f"shiftrightunsigned(others, {size} * piece) & {(1 << size) - 1}L").alias("part"))
    key = ["key", "piece", "part"]
    closer = cut(_sized(pieces, key))
    found = found.unionByName(_near(closer.where(f"n <= {RUN}"), key, most))
    found = found.unionByName(_forests(closer.where(f"n > {RUN} AND n <= {TILE}").select("fp", *key), key, most))
    found = found.unionByName(_tiled(closer.where(f"n > {TILE}"), key, most))
    return found.select(kind, "u", "v").distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the smallest id reachable from it over links.

    Null and empty texts share the fingerprint 0 and are linked like any other; a null id is never the
    smallest unless all ids of the component are null; rows that repeat get a row each; an empty table gives
    no rows. Texts are read whole.
    """
    given = docs.select(quoted(docs, doc_id).alias("doc_id"), quoted(docs, text).alias("text"))
    marked = cut(fingerprints(given, shingle=shingle).select("doc_id", F.col("fps")[0].alias("fp")))
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = cut(components(links(marked, most)))
    smallest = found.join(groups, found.node == groups.fp).groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    ids = groups.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- near copies by shingles, for a corpus


def text_key(text: Column) -> Column:
    """md5 of the text's words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased and joined by one space; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.md5(F.trim(F.regexp_replace(lowered, r"[\x20\x09-\x0D]+", " ")))


def _shingle_sets(nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, grams): the sorted distinct shingle hashes of each node's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 500):
            sets = [np.unique(np.frombuffer(b"".join(shingle_digests(space_words(t), shingle)), np.int64)) for t in texts(batch.column(1))]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], names=["node", "grams"])

    return nodes.select("node", "text").mapInArrow(run, "node string, grams array<bigint>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have this Jaccard similarity or more."""
    left, right = (sets.select(F.col("node").alias(n), F.col("grams").alias(f"grams_{n}")) for n in "uv")
    common = F.size(F.array_intersect("grams_u", "grams_v"))
    return pairs.join(left, "u").join(right, "v").where(common >= similarity * (F.size("grams_u") + F.size("grams_v") - common)).select("u", "v")


def _open(members: DataFrame, close: DataFrame) -> DataFrame:
    """(node, class, part, large) of the classes that the links leave in several parts; a class of two has no further pair."""
    found = components(close).withColumnRenamed("root", "part")
    placed = members.join(found, "node", "left").withColumn("part", F.coalesce("part", "node"))
    left = placed.groupBy("class").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
    return cut(placed.join(left.where("n > 2 AND low < high").select("class", (F.col("n") > LARGE).alias("large")), "class"))


def _joined(inside: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): every pair of one class and different parts that can be similar enough, by a prefix-filtered join.

    Shingles are ordered by how many texts of the class have them, rarest first. Pairs of one part are never made.
    """
    spread = inside.join(sets, "node").select("class", "part", "node", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    counts = spread.groupBy("class", "gram").agg(F.count("*").alias("n"))
    ordered = spread.join(counts.where("n > 1"), ["class", "gram"]).groupBy("class", "part", "node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
    # Shingles of one text only come first in the order and meet nothing; they use up places of the prefix.
    lone = F.col("size") - F.size("g")
    places = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9).cast("int") + 1 - lone
    heads = ordered.where(places > 0).select("class", "part", "node", "size", lone.alias("lone"), F.posexplode(F.slice("g.gram", F.lit(1), places)).alias("at", "gram"))
    heads = cut(heads.select("class", "part", "node", "size", "gram", (F.col("size") - F.col("lone") - F.col("at")).alias("rest")))
    mixed = heads.groupBy("class", "gram").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("class", "gram")
    heads = heads.join(mixed, ["class", "gram"])
    left, right = (heads.select("class", "gram", *[F.col(c).alias(f"{c}_{n}") for c in ("part", "node", "size", "rest")]) for n in "uv")
    # Length and positional filters: behind their first common shingle both texts must have the number that they need.
    common = F.ceil(similarity / (1 + similarity) * (F.col("size_u") + F.col("size_v")) - 1e-9)
    able = (F.least("size_u", "size_v") >= similarity * F.greatest("size_u", "size_v")) & (F.least("rest_u", "rest_v") >= common) & (F.col("part_u") < F.col("part_v"))
    return left.join(right, ["class", "gram"]).where(able).select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct()


def _complete(pairs: DataFrame, sets: DataFrame, close: DataFrame, similarity: float) -> DataFrame:
    """Links that connect whatever is connected by similar pairs inside the components of `pairs`, whether in `pairs` or not.

    In a class of more than LARGE texts the one whose shingles most others have is first compared with all the
    others, again among what has no such centre yet, while a round settles a quarter of them. What then is in
    different parts of a class is joined exactly, so rounds only save pairs that are connected anyway.
    """
    members = cut(components(pairs).withColumnRenamed("root", "class"))
    inside, centred, before = _open(members, close), None, None
    while True:
        free = inside.where("large")
        if centred is not None:
            free = free.join(free.join(centred, "node").select("part").distinct(), "part", "left_anti")
        left = free.count()
        if not left or (before is not None and left > 0.75 * before):
            break
        before = left
        spread = free.join(sets, "node").select("class", "node", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
        counts = spread.groupBy("class", "gram").agg(F.count("*").alias("n"))
        shared = spread.join(counts, ["class", "gram"]).groupBy("class", "node").agg((F.sum("n") / F.first("size")).alias("mean"))
        centres = cut(shared.groupBy("class").agg(F.max(F.struct("mean", "node")).alias("top")).select("class", F.col("top.node").alias("u")))
        own = centres.join(inside.select(F.col("node").alias("u"), F.col("part").alias("part_u")), "u")
        tried = own.join(inside, "class").where("part != part_u").select("u", F.col("node").alias("v"))
        close = cut(close.unionByName(_similar(tried, sets, similarity)))
        named = centres.select(F.col("u").alias("node"))
        centred = named if centred is None else centred.unionByName(named)
        inside = _open(members, close)
    return close.unionByName(_similar(cut(_joined(inside, sets, similarity)), sets, similarity))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, most: int = 3, views: int = 4
) -> DataFrame:
    """(doc_id, node, keep): for every different (id, text), whether it stays as the one of its group.

    Texts with the same words are one node. Candidates are nodes whose SimHash fingerprints over words,
    weighted by the square root of their counts, are at most `most` bits apart in one of the `views`; a link
    is a pair of nodes, connected by candidates, whose sets of `shingle`-word shingles have a Jaccard
    similarity of at least `similarity`, checked exactly on whole texts; no such pair is left out. (A fingerprint over the shingles themselves differs in
    about ten bits at 0.8, which is why candidates come from words.) Of each component the smallest id stays,
    of equal ids the smaller text key; null ids come last. `node` is text_key(text).
    """
    given = docs.select(quoted(docs, doc_id).alias("doc_id"), quoted(docs, text).alias("text"))
    keyed = given.withColumn("node", text_key(F.col("text")))
    marked = cut(word_fingerprints(keyed, views=views))
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")
    nodes = cut(marked.groupBy("node").agg(F.min(rank).alias("first"), F.first("fps").alias("fps")))
    marks = nodes.select("node", F.posexplode("fps").alias("view", "fp"))
    heads = cut(marks.groupBy("view", "fp").agg(F.min("node").alias("head")))
    pairs = marks.join(heads, ["view", "fp"]).where("node != head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    a, b = (heads.select("view", F.col("fp").alias(n), F.col("head").alias(h)) for n, h in ("ua", "vb"))
    met = links(heads, most).join(a, ["view", "u"]).join(b, ["view", "v"])
    pairs = pairs.unionByName(met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
    pairs = cut(pairs.where("u != v").distinct())
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ends = ends.join(nodes, "node").select("node", F.col("first.doc_id").alias("first_id"))
    found_texts = keyed.alias("d").join(ends.alias("e"), F.expr("d.doc_id <=> e.first_id AND d.node = e.node")).select("d.node", "d.text")
    sets = cut(_shingle_sets(found_texts.dropDuplicates(["node"]), shingle))
    found = components(_complete(pairs, sets, cut(_similar(pairs, sets, similarity)), similarity))
    placed = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    picked = placed.groupBy("root").agg(F.min(F.struct("first", "node")).alias("pick"))
    chosen = picked.select(F.col("pick.first.doc_id").alias("kept_id"), F.col("pick.node").alias("node"), F.lit(True).alias("keep"))
    every = marked.select("doc_id", "node").distinct()
    same = every.doc_id.eqNullSafe(chosen.kept_id) & (every.node == chosen.node)
    return every.join(chosen, same, "left").select(every.doc_id, every.node, F.coalesce("keep", F.lit(False)).alias("keep"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one of each group; of a row that repeats, one stays.

    Null and empty texts are one text; columns of any name, with dots or of the names used here, stay as they are.
    """
    judged = near_duplicates(docs, doc_id, text, **options).where("keep").select(F.col("doc_id").alias("id"), F.col("node").alias("kept"))
    whole = F.struct(*[quoted(docs, c).alias(c) for c in docs.columns])
    marked = docs.select(whole.alias("row"), quoted(docs, doc_id).alias("own"), text_key(quoted(docs, text)).alias("node"))
    kept = marked.join(judged, F.col("own").eqNullSafe(F.col("id")) & (F.col("node") == F.col("kept")), "left_semi")
    if not marked.groupBy("own", "node").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["own", "node"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
