"""Similarity of texts: term vectors by cosine, short titles by matching blocks.

Nothing is lost: what a filter or bound leaves out can't reach the threshold, and what is left is verified.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.sources import tables as tb

def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Twice the characters in matching blocks over both lengths; 0.0 where a bound shows that it is below `least`.

    Not symmetric: blocks are looked for from a in b.
    """
    total = len(a) + len(b)
    if not total:
        return 1.0
    if 2 * min(len(a), len(b)) < least * total - 1e-9 or 2 * (Counter(a) & Counter(b)).total() < least * total - 1e-9:
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


def ratio_bound(a: str, b: str) -> float:
    """No less than the ratio: matching blocks are a common subsequence, whose greatest length is counted with a bit for
    each character of a, all at once."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    every = (1 << len(a)) - 1
    open_ = every
    for c in b:
        here = open_ & places.get(c, 0)
        if here:
            open_ = ((open_ + here) | (open_ - here)) & every
    return 2 * (len(a) - open_.bit_count()) / total


#: Texts whose terms are numbered together.
PART = 2000
_COUNTED = "part long, id long, places array<int>, counts array<int>, terms array<long>, texts array<int>"


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values, kind))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct terms, as places in the terms of its part, and how often it has them; the terms and how many of
    the part's texts have each stand in its first row. A part is named by that row's id."""
    for batch in batches:
        for first in range(0, batch.num_rows, PART):
            rows = batch.slice(first, PART)
            n, words = rows.num_rows, rows.column(1)
            terms, place = np.unique(words.flatten().to_numpy().astype(np.int64), return_inverse=True)
            owner = np.repeat(np.arange(n), words.value_lengths().fill_null(0).to_numpy())
            keys, counts = np.unique(owner * max(1, len(terms)) + place, return_counts=True)
            owner, place = np.divmod(keys, max(1, len(terms)))
            own = np.zeros(n, np.int64)
            own[0] = len(terms)
            columns = [
                pa.array(np.full(n, rows.column(0)[0].as_py())), rows.column(0), _lists(place, np.bincount(owner, minlength=n), pa.int32()),
                _lists(counts, np.bincount(owner, minlength=n), pa.int32()), _lists(terms, own, pa.int64()), _lists(np.bincount(place, minlength=len(terms)), own, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "id", "places", "counts", "terms", "texts"])


def _weighed(counted: pa.Table, known: pa.Table) -> pa.Table:
    """The unit vectors of a part."""
    known = known.sort_by("place")
    terms, weights = known["term"].to_numpy(), known["weight"].to_numpy()
    found = [[], [], []]
    for number, places, counts in zip(counted["id"].to_pylist(), counted["places"], counted["counts"]):
        places = places.values.to_numpy()
        own = counts.values.to_numpy() * weights[places]
        kept = own > 0
        if kept.any():
            own = own[kept]
            for column, value in zip(found, (number, terms[places[kept]], own / np.sqrt(np.cumsum(own * own)[-1]))):  # in their order
                column.append(value)
    sizes = np.array([len(t) for t in found[1]], np.int64)
    made = [_lists(np.concatenate(column or [np.zeros(0)]), sizes, kind) for column, kind in zip(found[1:], (pa.int64(), pa.float64()))]
    return pa.table([pa.array(found[0], pa.int64()), *made], names=["id", "terms", "weights"])


def term_vectors(texts: DataFrame) -> DataFrame:
    """(id, terms, weights) for texts (id, body): unit vectors of counts times ln((1 + N) / (1 + texts with the term)).

    terms are hashes in ascending order. A text of no words, or of words that all texts have, has no vector. N is a
    row of its own that the terms' counts are joined with, so nothing is counted while the plan is made. Terms are
    counted and looked up once for each part of 2,000 texts at most, not once for each text.
    """
    hashes = F.transform(tx.words(F.col("body")), lambda w: F.xxhash64(w))
    counted = tb.written(texts.select("id", hashes.alias("words")).mapInArrow(_counts, _COUNTED))
    spread = counted.where("size(terms) > 0").select("part", F.posexplode(F.arrays_zip("terms", "texts")).alias("place", "e")).select("part", "place", F.col("e.terms").alias("term"), F.col("e.texts").alias("texts"))
    total = counted.agg(F.count("*").alias("total"))
    rarity = spread.groupBy("term").agg(F.sum("texts").alias("df")).join(F.broadcast(total))  # one row
    weight = F.log((1 + F.col("total")) / (1 + F.col("df"))).alias("weight")
    known = spread.drop("texts").join(rarity.select("term", weight), "term").select(F.col("part").alias("of"), "place", "term", "weight")
    return counted.select("part", "id", "places", "counts").groupBy("part").cogroup(known.groupBy("of")).applyInArrow(_weighed, "id long, terms array<long>, weights array<double>")


def heads(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, term): the rarest terms of each unit vector, up to where the rest is shorter than the threshold.

    If two vectors have no such term in common, the rarest term they share lies in the rest of one of them, and so
    does all that they share: their cosine is at most that rest's length.
    """
    spread = vectors.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("e")).select("id", F.col("e.terms").alias("term"), F.col("e.weights").alias("weight"))
    rarity = spread.groupBy("term").agg(F.count("*").alias("df"))
    rest = Window.partitionBy("id").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    kept = spread.join(rarity, "term").withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(rest))
    return kept.where(F.col("rest") >= (threshold - 1e-9) ** 2).where("df > 1").select("id", "term")


def cosine(a_terms: np.ndarray, a_weights: np.ndarray, b_terms: np.ndarray, b_weights: np.ndarray) -> float:
    _, i, j = np.intersect1d(a_terms, b_terms, assume_unique=True, return_indices=True)
    return float(a_weights[i] @ b_weights[j])


def cosine_in_order(a_terms: np.ndarray, a_weights: np.ndarray, b_terms: np.ndarray, b_weights: np.ndarray) -> float:
    """The cosine, its terms added in their order."""
    _, i, j = np.intersect1d(a_terms, b_terms, assume_unique=True, return_indices=True)
    return float(np.cumsum(np.asarray(a_weights)[i] * np.asarray(b_weights)[j])[-1]) if len(i) else 0.0


def near(hours: int, times: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Pairs a < b of ids that share a key and have times within so many hours: keyed has id and key, times id and ts.

    Each id stands in the spans of its times; it meets ids of the same span and of the one before.
    """
    span = (F.unix_timestamp("ts") / (3600 * hours)).cast("long")
    spans = times.select("id", span.alias("span")).distinct()
    own = keyed.join(spans, "id").select(key, "span", "id")
    left = own.select(key, "span", F.col("id").alias("x"))
    right = own.select(key, F.explode(F.array("span", F.col("span") + 1)).alias("span"), F.col("id").alias("y"))
    met = left.join(right, [key, "span"]).where("x != y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def cosine_pairs(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine) of the candidate pairs whose vectors are at least this near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, bt, weights = (batch.column(k) for k in (2, 3, 4, 5))
            found = [cosine(*(c[i].values.to_numpy() for c in (at, terms, bt, weights))) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "cosine"])

    joined = pairs.join(vectors.toDF("a", "at", "aw"), "a").join(vectors.toDF("b", "bt", "bw"), "b").select("a", "b", "at", "aw", "bt", "bw")
    return joined.mapInArrow(run, "a long, b long, cosine double").where(F.col("cosine") >= threshold - 1e-9)


def characters(title: str, buckets: int = 64) -> np.ndarray:
    """How many of a title's characters are in each bucket of code points."""
    return np.bincount(np.frombuffer(title.encode("utf-32-le", "surrogatepass"), "<u4") % buckets, minlength=buckets).astype(np.int32)


class Ratios:
    """Ratios of a group's titles, each pair of different ones computed once."""

    def __init__(self, titles: list[str], least: float, buckets: int = 64) -> None:
        self.titles, self.least, self.known = titles, least, {}
        self.sizes = np.array([len(t) for t in titles], np.int32)
        self.counts = np.ascontiguousarray(np.array([characters(t, buckets) for t in titles], np.int32).reshape(-1, buckets).T)

    def able(self, some: np.ndarray, those: slice) -> np.ndarray:
        """Which titles have enough characters in common; characters of a bucket count as equal."""
        common = np.zeros((len(some), those.stop - those.start), np.int32)
        for own in self.counts:
            common += np.minimum.outer(own[some], own[those])
        return 2 * common >= self.least * np.add.outer(self.sizes[some], self.sizes[those]) - 1e-9

    def __call__(self, x: int, y: int) -> float:
        key = (self.titles[x], self.titles[y])
        if key not in self.known:
            self.known[key] = ratio(*key, self.least)
        return self.known[key]


class Cosines:
    """Cosines of a group's unit vectors (lists of ascending terms and of weights)."""

    def __init__(self, terms: pa.ChunkedArray, weights: pa.ChunkedArray, buckets: int = 1024) -> None:
        terms, weights = terms.combine_chunks(), weights.combine_chunks()
        self.at = np.append(0, np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        self.terms, self.weights = terms.flatten().to_numpy(), weights.flatten().to_numpy()
        self.sums = np.zeros((len(terms), buckets), np.float32)
        np.add.at(self.sums, (np.repeat(np.arange(len(terms)), np.diff(self.at)), self.terms % buckets), self.weights)

    def able(self, some: np.ndarray, those: slice, least: float) -> np.ndarray:
        """Which may be so near: weights are positive, so sums over buckets of terms have no smaller product."""
        return self.sums[some] @ self.sums[those].T >= least - 1e-4

    def __call__(self, x: int, y: int) -> float:
        a, b = (slice(self.at[i], self.at[i + 1]) for i in (x, y))
        return cosine(self.terms[a], self.weights[a], self.terms[b], self.weights[b])
