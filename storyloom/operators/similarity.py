"""Similarity of sets, contexts and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.sources import tables as tb

#: Parts that members are dealt over where overlaps must have some size, and the rows of a part that a task may hold.
PARTS, MOST = 32, 8_000_000


def meetings(owner: np.ndarray, key: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, n) in blocks: owners x < y that have n > 0 keys in common; owners and keys are small whole numbers, no row repeats.

    A block has all pairs of some owners, so counts are whole; no more than `most` meetings are held at once, or those of
    one owner.
    """
    order = np.lexsort((owner, key))
    owner, key = owner[order].astype(np.int32), key[order].astype(np.int32)
    del order
    later = (np.searchsorted(key, key, "right") - np.arange(1, len(key) + 1)).astype(np.int32)  # rows of the same key behind each
    del key
    rows = np.argsort(owner, kind="stable").astype(np.int32)
    rows = rows[later[rows] > 0]
    total, width = np.cumsum(later[rows], dtype=np.int64), int(owner.max(initial=0)) + 1
    begin = np.append(0, np.cumsum(np.bincount(owner[rows], minlength=width)))  # of each owner's rows
    first = 0
    while first < len(rows):
        before = total[first - 1] if first else 0
        last = int(np.searchsorted(total, before + most, "right"))
        at = owner[rows[min(last, len(rows) - 1)]]
        last = int(begin[at])  # owners before the one that is too much
        if last <= first:
            last = int(begin[owner[rows[first]] + 1])
        if total[-1] - before <= most:
            last = len(rows)
        own = rows[first:last].astype(np.int64)
        sizes = later[own].astype(np.int64)
        at = np.repeat(own + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        pairs, n = np.unique(np.repeat(owner[own].astype(np.int64), sizes) * width + owner[at], return_counts=True)
        yield pairs // width, pairs % width, n
        first = last


class _Codes:
    """Values of batches as small whole numbers, without a copy of them all."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, values: np.ndarray) -> np.ndarray:
        """Where each of the batch's different values stands first."""
        names, first, codes = np.unique(values, return_index=True, return_inverse=True)
        self.parts.append((names, codes.astype(np.int32)))
        return first

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """The values in their order, and each row's place among them."""
        names = np.unique(np.concatenate([n for n, _ in self.parts]))
        codes = np.concatenate([np.searchsorted(names, n).astype(np.int32)[c] for n, c in self.parts])
        self.parts = []
        return names, codes


def _candidates(own: DataFrame, least: float, rows: int = 0) -> DataFrame:
    """(a, b) that share, in one part of the members, as much of what they need for this Jaccard similarity as falls to it.

    own has owner, size and member, no more than so many rows. Pairs are counted in the task that has the part, so only
    candidates are shuffled. A task holds two whole numbers for each row; a part of more than MOST rows is dealt by its
    owners, and every two blocks of them are a task.
    """
    field = own.schema["owner"].dataType.simpleString()
    blocks = 1 if rows <= PARTS * MOST else -(-2 * rows // (PARTS * MOST))  # two are a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, members, sizes, homes, kind, between = _Codes(), _Codes(), [], [], None, False
        for batch in batches:
            kind = batch.schema.field("owner").type
            first = owners.add(batch.column("owner").to_numpy(zero_copy_only=False))
            members.add(batch.column("member").to_numpy(zero_copy_only=False))
            sizes.append(batch.column("size").to_numpy()[first])
            if blocks > 1:
                between = batch.column("i")[0].as_py() != batch.column("j")[0].as_py()
                homes.append(batch.column("home").to_numpy()[first])
        each = np.concatenate([n for n, _ in owners.parts])
        names, owner = owners.done()
        place = np.searchsorted(names, each)
        need, home = np.zeros(len(names)), np.zeros(len(names), np.int32)
        need[place] = np.concatenate(sizes) * (least / (1 + least) / PARTS)
        if between:
            home[place] = np.concatenate(homes)
        for x, y, n in meetings(owner, members.done()[1], 1 << 20):
            able = n >= need[x] + need[y] - 1e-9
            if between:  # owners of one block meet where that block is alone
                able &= home[x] != home[y]
            if able.any():
                a, b = (names[c[able]] for c in (x, y))
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    placed, keys = own.select("owner", "size", "member", F.pmod(F.xxhash64("member"), F.lit(PARTS)).alias("part")), ["part"]
    if blocks > 1:
        home = F.pmod(F.xxhash64("owner"), F.lit(blocks)).cast("int")
        groups = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(k, home).alias("i"), F.greatest(k, home).alias("j")))
        placed, keys = placed.withColumn("home", home).select("*", F.explode(groups).alias("g")).select("*", "g.i", "g.j").drop("g"), ["part", "i", "j"]
    return placed.groupBy(*keys).applyInArrow(run, f"a {field}, b {field}").distinct()


def overlap(members: DataFrame, of: str, member: str, least: float = 0.0, least_common: int = 1) -> DataFrame:
    """(a, b, common, score) for two owners that share members: the Jaccard similarity of their sets, at least `least`.

    Only owners with a member in common meet, and only those that can have the least similarity leave the task where they
    do; these are then counted over all members.
    """
    own = members.select(F.col(of).alias("owner"), F.col(member).alias("member")).where("owner IS NOT NULL AND member IS NOT NULL").distinct()
    sizes = own.groupBy("owner").agg(F.count("*").alias("size"))
    left, right = own.select(F.col("owner").alias("a"), "member"), own.select(F.col("owner").alias("b"), "member")
    if least > 0:
        able = tb.written(_candidates(own.join(sizes, "owner"), least, members.count()))
        met = able.join(left, "a").join(right, ["b", "member"])
    else:
        met = left.join(right, "member").where("a < b")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("common")).where(F.col("common") >= least_common)
    sized = pairs.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
    score = F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
    return sized.where(score >= least).select("a", "b", "common", F.round(score, 6).alias("score"))


def context(members: DataFrame, of: str, member: str) -> DataFrame:
    """(a, b, shared, score): how far b stands in a's articles; a pair without a shared article (0.4) isn't listed.

    A pair is counted once for both its directions, and brings the sizes of its owners with it.
    """
    own = members.select(F.col(of).alias("owner"), F.col(member).alias("member")).distinct()
    own = own.join(own.groupBy("owner").agg(F.count("*").alias("size")), "owner")
    left, right = (own.select("member", F.col("owner").alias(n), F.col("size").alias(f"size_{n}")) for n in "ab")
    pairs = tb.dealt(left.join(right, "member").where("a < b").drop("member"), members, "a", "b").groupBy("a", "b")
    counts = pairs.agg(F.count("*").alias("shared"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    ways = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(f"size_{x}").alias("size")) for x, y in ("ab", "ba")])
    both = counts.select("shared", F.explode(ways).alias("p")).select("p.*", "shared")
    return both.select("a", "b", "shared", F.round(F.least(F.lit(0.85), 0.5 + 0.7 * F.col("shared") / F.col("size")), 6).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors in [0, 1]; 0 if either is empty or zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)

    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / length))).otherwise(0.0)


def combined(text: Column, entities: Column) -> Column:
    """0.6 of the text's similarity and 0.4 of the entities'; the text's alone where sets are missing."""
    return F.when(entities.isNull(), text).otherwise(0.6 * text + 0.4 * entities)
