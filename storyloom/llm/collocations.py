"""Phrase collocations, their counts mined by SON partitioning.

Texts are dealt into shards, and a phrase that occurs `support` times in a language occurs in at least one shard
at least as often as the shard's share of the language's words asks for. So each shard is mined completely at its
own lowered support: words first, then pairs of locally frequent words, then triples and quadruples whose pairs
are all locally frequent. What is frequent in any shard is a candidate, and one more pass counts all candidates
over all texts exactly.

A shard is as large as its share of the corpus, so none lies in one task: shards are a part of the key by which
Spark groups, each task first adds up its own texts, and all shards are mined side by side. Which shorter phrases
are frequent reaches the tasks as a hashed bitmap of fixed size (2^26 bits, 8 MB, whatever the corpus), built by
Spark; a wrong bit lets a phrase be counted in vain, never be lost, and every count kept is of exact phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm._common import LOWER, cut, quoted, small_batches

#: Words of the longest phrase.
LONGEST = 4
UNKNOWN = "und"
#: Bits of the bitmap; a bucket of Spark's bitmap functions has 32768.
BITS = 1 << 26
_BUCKET = 1 << 15
#: A task counts so many bytes of text at once.
_AT_ONCE = 4 << 20
#: A-Z lower-cased, the ends of pieces as line feeds, tabs as spaces.
_PLAIN = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in LOWER)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _place(groups: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The bit of each phrase: hashes of its group, then of each word."""
    h = groups
    for w in words:
        h = _mixed(h * _MIX[0] + w)
    return h & np.uint64(BITS - 1)


def _hashes(values: list) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), np.uint64, len(values))


def _group_hashes(langs: pa.Array, shards: np.ndarray) -> np.ndarray:
    coded = langs.dictionary_encode()
    return _mixed(_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()] + shards.astype(np.uint64) * _MIX[0])


class Words:
    """The words of some texts, one after the other, as numbers; pieces and groups by word."""

    def __init__(self, texts: list[pa.Array], langs: pa.Array, shards: np.ndarray) -> None:
        held = [c.fill_null("") for c in texts]
        joined = pa.concat_arrays(held)
        offsets, data = joined.buffers()[1:]
        plain = pa.StringArray.from_buffers(len(joined), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_PLAIN)), None, 0, joined.offset)
        pieces = pc.split_pattern(plain, "\n")
        of_piece = np.repeat(np.arange(len(plain), dtype=np.int32), pc.list_value_length(pieces).to_numpy())
        words = pc.split_pattern(pieces.flatten(), " ")
        piece = np.repeat(np.arange(len(of_piece), dtype=np.int32), pc.list_value_length(words).to_numpy())
        flat = words.flatten()
        there = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(there).dictionary_encode()
        self.dictionary, self.ids = coded.dictionary, coded.indices.to_numpy()
        self.piece = piece[there.to_numpy(zero_copy_only=False)]
        self.group_keys, self.groups = self._grouped(langs, shards, of_piece[self.piece])
        self.hashed: tuple[np.ndarray, np.ndarray] | None = None

    def _grouped(self, langs: pa.Array, shards: np.ndarray, row: np.ndarray) -> tuple[tuple[pa.Array, np.ndarray], np.ndarray]:
        coded = langs.dictionary_encode()
        keys, group = np.unique(coded.indices.to_numpy().astype(np.int64) << 32 | shards, return_inverse=True)
        return (coded.dictionary.take(pa.array(keys >> 32)), keys & 0xFFFFFFFF), group.astype(np.int32)[row] if len(keys) else row

    def bits(self, at: np.ndarray, k: int, bitmap: np.ndarray) -> np.ndarray:
        """Whether the bitmap has the phrases of k words that begin at the places `at`."""
        if self.hashed is None:
            self.hashed = _group_hashes(*self.group_keys), _hashes(self.dictionary.cast(pa.binary()).to_pylist())
        groups, words = self.hashed
        place = _place(groups[self.groups[at]], [words[self.ids[at + j]] for j in range(k)])
        return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def starts(self, k: int) -> np.ndarray:
        """Places where a phrase of k words begins within a piece."""
        n = len(self.ids) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def counted(self, at: np.ndarray, k: int) -> pa.RecordBatch:
        """(lang, shard, phrase, n) of the different phrases of k words at these places."""
        size = len(self.dictionary)
        number = self.groups[at].astype(np.int64)
        for j in range(k):
            number = number * size + self.ids[at + j]
            if j in (1, 2):  # fewer numbers, so that the next product stays below 2^63
                number = np.unique(number, return_inverse=True)[1]
        _, first, n = np.unique(number, return_index=True, return_counts=True)
        one = at[first]
        parts = [self.dictionary.take(pa.array(self.ids[one + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
        langs, shards = self.group_keys
        group = self.groups[one]
        return pa.RecordBatch.from_arrays([langs.take(pa.array(group)), pa.array(shards[group].astype(np.int32)), phrase, pa.array(n.astype(np.int64))], names=["lang", "shard", "phrase", "n"])


def _count(given: DataFrame, sizes: tuple[int, ...], known: object = None, of: int = 0) -> DataFrame:
    """(lang, shard, phrase, n): counts of the phrases of these sizes; only of those that the bitmap allows.

    `of` is the size of the phrases in the bitmap: a longer phrase is counted if all phrases of that size in it are
    there; with 0, a phrase must be there itself.
    """

    def counts(words: Words) -> Iterator[pa.RecordBatch]:
        bitmap = None if known is None else known.value
        part = None
        for k in sizes:
            at = words.starts(k)
            if bitmap is not None and not of:
                at = at[words.bits(at, k, bitmap)]
            elif bitmap is not None:
                if part is None:
                    part = np.zeros(len(words.ids), bool)
                    whole = words.starts(of)
                    part[whole] = words.bits(whole, of, bitmap)
                for j in range(k - of + 1):
                    at = at[part[at + j]]
            if len(at):
                yield words.counted(at, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            shards = np.concatenate([b.column(2).to_numpy() for b in held]).astype(np.int64)
            yield from counts(Words([b.column(0) for b in held], pa.concat_arrays([b.column(1) for b in held]), shards))

        for batch in batches:
            lengths = np.cumsum(pc.binary_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                base = lengths[at - 1] if at else 0
                until = max(at + 1, int(np.searchsorted(lengths, base + _AT_ONCE - size, "right")))
                held.append(batch.slice(at, until - at))
                size += int(lengths[until - 1] - base)
                at = until
                if size >= _AT_ONCE or at < batch.num_rows:
                    yield from done()
                    held, size = [], 0
        if held:
            yield from done()

    made = given.mapInArrow(run, "lang string, shard int, phrase string, n long")
    return made.groupBy("lang", "shard", "phrase").agg(F.sum("n").alias("n"))


def _bitmap(phrases: DataFrame) -> object:
    """The hashed bitmap of (lang, shard, phrase) rows, as a broadcast of BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = _group_hashes(batch.column(0), batch.column(1).to_numpy())
            split = [p.split(b" ") for p in batch.column(2).cast(pa.binary()).to_pylist()]
            out = np.zeros(len(split), np.uint64)
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            for k in np.unique(sizes):
                own = np.flatnonzero(sizes == k)
                out[own] = _place(groups[own], [_hashes([split[i][j] for i in own.tolist()]) for j in range(k)])
            yield pa.RecordBatch.from_arrays([pa.array(out.astype(np.int64))], names=["place"])

    placed = phrases.select("lang", "shard", "phrase").mapInArrow(run, "place long")
    buckets = placed.groupBy((F.col("place") / _BUCKET).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(_BUCKET))).alias("bits"))
    bitmap = np.zeros(BITS // 8, np.uint8)
    for r in buckets.collect():  # BITS / 32768 rows of 4 KB at most
        bitmap[r.bucket * (_BUCKET // 8) : (r.bucket + 1) * (_BUCKET // 8)] = np.frombuffer(bytes(r.bits), np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(bitmap)


def phrase_counts(docs: DataFrame, support: int = 30, shards: int = 4, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of 1 to 4 words that occur `support` times or more, and (lang, n) of all words."""
    small_batches(docs.sparkSession)
    given = docs.select(quoted(docs, text).alias("text"), F.coalesce(quoted(docs, lang), F.lit(UNKNOWN)).alias("lang"))
    given = given.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
    words = cut(_count(given, (1,)))
    shares = words.groupBy("lang", "shard").agg(F.sum("n").alias("held"))
    totals = cut(words.groupBy("lang").agg(F.sum("n").alias("n")))
    # As often as the shard's share of the language's words asks for, rounded up.
    least = F.expr(f"cast((cast(held AS decimal(38,0)) * {support} + n - 1) div n AS long)").alias("least")
    local = cut(shares.join(totals, "lang").select("lang", "shard", least))  # a row for each language and shard

    def frequent(counts: DataFrame) -> DataFrame:
        return counts.join(local, ["lang", "shard"]).where("n >= least").select("lang", "shard", "phrase")

    pairs = cut(frequent(_count(given, (2,), _bitmap(frequent(words)), 1)))
    longer = cut(frequent(_count(given, (3, LONGEST), _bitmap(pairs), 2)))
    # The union over shards; a phrase of one word needs no second count, as words are counted in every shard.
    candidates = pairs.union(longer).select("lang", F.lit(0).alias("shard"), "phrase")
    everywhere = given.withColumn("shard", F.lit(0))
    counted = _count(everywhere, tuple(range(2, LONGEST + 1)), _bitmap(candidates)).select("lang", "phrase", "n")
    single = words.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return cut(single.union(counted).where(F.col("n") >= support)), totals


def _slices(words: Column, sizes: Column) -> Column:
    """All runs of `sizes` words, as phrases."""
    return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))


def collocations(docs: DataFrame, support: int = 30, top: int = 2000, contained: int = 80, shards: int = 4, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to 4 words.

    Words stand between spaces and tabs, phrases within pieces that end at `.,;:!?` or a line's end, A-Z lower-cased.
    a is a phrase's count, n the language's words. Of the ways to cut a phrase in two, the one of the lowest score
    counts, the first of several; l and r are the counts of its parts and the score is 2,000,000 a / (l + r), rounded
    down. A phrase that lies in a longer frequent one of at least `contained` percent of its count is left out. Order:
    score and a falling, then the phrase's bytes. All arithmetic is exact.

    A null text is empty; a null lang is `und`; repeated rows count each. Texts are read whole, and one longer than
    4 MB is counted at once. A language without such phrases, or an empty table, gives no rows. Further columns,
    whatever their names, are not looked at.
    """
    frequent, totals = phrase_counts(docs, support, shards, text, lang)
    parts = F.split("phrase", " ")
    phrases = frequent.withColumn("words", parts).where(F.size("words") > 1).select("lang", "phrase", "words", F.col("n").alias("a"))

    joined = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    ways = F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda k: F.struct(k.alias("k"), joined(F.lit(1), k).alias("first"), joined(k + 1, F.size("words") - k).alias("rest")),
    )
    cuts = phrases.select("lang", "phrase", "a", F.explode(ways).alias("cut")).select("lang", "phrase", "a", "cut.*")
    counts = lambda part, n: frequent.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    both = cuts.join(counts("first", "l"), ["lang", "first"]).join(counts("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(2000000 AS decimal(38,0)) * a div (l + r)")
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))

    inner = F.expr(f"sequence(2, {LONGEST - 1})")
    inside = phrases.where(F.size("words") > 2).select("lang", "a", F.explode(F.array_distinct(_slices(F.col("words"), F.filter(inner, lambda k: k < F.size("words"))))).alias("phrase"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longest, ["lang", "phrase"], "left").where(f"longer IS NULL OR cast(longer AS decimal(38,0)) * 100 < cast(a AS decimal(38,0)) * {contained}")

    # First within parts of a language, so that no task sorts all of its phrases.
    order = [F.desc("m.score"), F.desc("a"), "phrase"]
    within = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = kept.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")
