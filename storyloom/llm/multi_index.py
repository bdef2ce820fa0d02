"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to unit length and halved; each half is quantised to its own centroids, and a vector's
cell is its pair of centroids. A query visits cells in the order of the summed distances of its halves to
the pair's centroids, which a heap yields one by one without looking at all pairs, until the cells visited
hold the wanted share of all vectors. All vectors of these cells, and no others, are then reranked by their
exact cosine.

The index holds every vector; only the centroids come from a bounded sample. Equal vectors enter it at most
k + 1 times, those of the smallest ids: no other copy can be among a query's k nearest. Cells lie in blocks
of bounded size, a crowded cell in several; queries lie in parts of bounded size, and a block goes to the
parts with a query that visits it. As cells are visited in the order of their distance, the last distance
says which cells a query has visited, so no list of cells travels with it.

On vectors without any cluster structure a recall of 0.9 takes a quarter of all vectors, whatever the index;
`share` says how much to visit. Measured on Gaussian vectors of 64 dimensions, a share of 0.35 found 0.93 to
0.96 of the five nearest, with 500 to 50,000 vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm._common import cut, quoted


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k centroids (fewer if there are fewer different points)."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    centroids = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = _distances(points, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=k)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


@dataclass
class Cells:
    """The two sets of centroids and where each cell's vectors are kept."""

    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray  # vectors by cell
    first_block: np.ndarray  # by cell
    blocks: np.ndarray  # how many blocks a cell is dealt over
    rows: list[list[int]] = field(default_factory=list)  # counts, by the first half's centroid

    def split(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = unit.shape[1] // 2
        return _distances(unit[:, :half], self.halves[0]), _distances(unit[:, half:], self.halves[1])

    def assign(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.split(unit)
        return a.argmin(1) * len(self.halves[1]) + b.argmin(1)

    def lay_out(self, counts: dict[int, int], block_rows: int) -> None:
        size = len(self.halves[0]) * len(self.halves[1])
        self.counts, self.first_block, self.blocks = np.zeros(size, np.int64), np.zeros(size, np.int64), np.ones(size, np.int64)
        block, held = 0, 0
        for cell in sorted(counts):
            n = self.counts[cell] = counts[cell]
            if held and held + n > block_rows:
                block, held = block + 1, 0
            self.first_block[cell] = block
            self.blocks[cell] = -(-n // block_rows)
            held += n
            if self.blocks[cell] > 1:
                block, held = block + int(self.blocks[cell]), 0
        self.rows = self.counts.reshape(len(self.halves[0]), -1).tolist()

    def reach(self, a: np.ndarray, b: np.ndarray, wanted: int) -> float:
        """The summed distance up to which cells are visited, nearest pairs of centroids first, to see `wanted` vectors.

        The heap has, for each centroid of the first half, its nearest pair not yet visited.
        """
        right = np.argsort(b, kind="stable")
        near, columns, wide = b[right].tolist(), right.tolist(), len(b)
        counts = self.rows
        heap = [(x + near[0], i, 0, x) for i, x in enumerate(a.tolist())]
        heapq.heapify(heap)
        held, last = 0, -np.inf
        while heap and held < wanted:
            last, i, j, x = heap[0]
            held += counts[i][columns[j]]
            if j + 1 < wide:
                heapq.heapreplace(heap, (x + near[j + 1], i, j + 1, x))
            else:
                heapq.heappop(heap)
        return last

    def visited(self, a: np.ndarray, b: np.ndarray, reach: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Queries by cells: whether the query, of these distances and this reach, visits the cell."""
        wide = len(self.halves[1])
        return a[:, cells // wide] + b[:, cells % wide] <= reach[:, None]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 5,
    share: float = 0.35,
    centroids: int = 128,
    sample: int = 5000,
    block_rows: int = 10_000,
    block_queries: int = 10_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors found, other than those of its own id.

    Both frames have an id and an embedding. score is the cosine of the original vectors in double precision;
    the nearest come first, ties by the smaller id. `share` of the vectors, and at least k + 1, are reranked
    for each query. Vectors that are null, empty, zero, of another length than most, or hold a null or
    non-finite component take no part, as queries neither; repeated rows count once; fewer than k candidates
    are all returned if visited; an empty table gives no rows. Further columns, whatever their names, are not
    looked at. The centroids are fitted on about `sample` vectors.
    """
    usable = F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x != 0)")
    given, asked = (d.select(quoted(d, vec_id).cast("long").alias("vec_id"), quoted(d, embedding).cast("array<double>").alias("v")).where(usable) for d in (vectors, queries))
    lengths = given.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = lengths[0].n if lengths else 1
    given, asked = (d.where(F.size("v") == dim) for d in (given, asked))
    copies = Window.partitionBy("v").orderBy("vec_id")
    kept = cut(given.distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"))
    total = kept.count()
    drawn = kept.where(F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, sample / max(1, total)) * (1 << 30))).select("v").distinct()
    points = np.array([r.v for r in drawn.collect()] or [[1.0] * dim])
    points = _unit(points[np.lexsort(points.T)])
    half = dim // 2
    cells = Cells((kmeans(points[:, :half], centroids), kmeans(points[:, half:], centroids)), *[np.zeros(0, np.int64)] * 3)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cells.assign(_unit(_matrix(batch.column(1), dim)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=["vec_id", "v", "cell"])

    index = cut(kept.mapInArrow(place, "vec_id bigint, v array<double>, cell bigint"))
    cells.lay_out({r.cell: r["count"] for r in index.groupBy("cell").count().collect()}, block_rows)  # one count for each cell
    wanted = max(k + 1, int(np.ceil(share * total)))
    full = np.flatnonzero(cells.counts)
    asked = asked.distinct()
    parts = max(1, -(-asked.count() // block_queries))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(full):
                continue
            a, b = cells.split(_unit(_matrix(batch.column(1), dim)))
            reach = np.array([cells.reach(x, y, wanted) for x, y in zip(a, b)])
            blocks = []
            for row in cells.visited(a, b, reach, full):
                own = full[row]
                many = cells.blocks[own] > 1
                more = [np.arange(cells.first_block[c], cells.first_block[c] + cells.blocks[c]) for c in own[many]]
                blocks.append(np.unique(np.concatenate([cells.first_block[own], *more])).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach), pa.array(blocks, pa.list_(pa.int64()))], names=["query_id", "v", "part", "reach", "blocks"])

    split = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).alias("part"))
    asking = cut(split.mapInArrow(probe, "query_id bigint, v array<double>, part bigint, reach double, blocks array<bigint>"))
    probes = asking.select("query_id", "v", "reach", "part", F.explode("blocks").alias("block"))
    visits = asking.select(F.col("part").alias("to"), F.explode("blocks").alias("in")).distinct()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy()
            spread = np.array([hash(x) for x in batch.column(0).to_pylist()], np.int64) if batch.num_rows else np.zeros(0, np.int64)
            block = cells.first_block[cell] + spread % cells.blocks[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=["vec_id", "v", "cell", "block"])

    dealt = index.mapInArrow(deal, "vec_id bigint, v array<double>, cell bigint, block bigint")
    dealt = dealt.join(visits, F.col("block") == F.col("in")).select("vec_id", "v", "cell", "block", F.col("to").alias("part"))

    def rerank(found: pa.Table, wanted_by: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(found) and len(wanted_by):
            found = found.take(pa.array(np.argsort(found["cell"].to_numpy(), kind="stable")))
            own, query = _matrix(found["v"], dim), _matrix(wanted_by["v"], dim)
            held, firsts = np.unique(found["cell"].to_numpy(), return_index=True)
            until = [*firsts[1:].tolist(), len(own)]
            none = np.iinfo(np.int64).max
            number, asker = (t.fill_null(none).to_numpy() for t in (found["vec_id"], wanted_by["query_id"]))
            reach, unit, unit_query = wanted_by["reach"].to_numpy(), _unit(own), _unit(query)
            lengths, query_lengths = np.sqrt((own * own).sum(1)), np.sqrt((query * query).sum(1))
            for at in range(0, len(query), 200):
                some = slice(at, at + 200)
                visited = cells.visited(*cells.split(unit_query[some]), reach[some], held)
                near = np.full((len(visited), len(own)), -np.inf)
                for c, (first, last) in enumerate(zip(firsts.tolist(), until)):
                    askers = np.flatnonzero(visited[:, c])
                    if len(askers):
                        near[askers, first:last] = unit_query[at + askers] @ unit[first:last].T
                near[(number[None, :] == asker[some, None]) & (asker[some, None] != none)] = -np.inf
                edge = np.partition(near, -k, 1)[:, -k] if len(own) > k else np.full(len(near), -np.inf)
                who, which = np.nonzero((near >= edge[:, None] - 1e-9) & (near > -np.inf))
                exact = (own[which] * query[at + who]).sum(1) / (lengths[which] * query_lengths[at + who])  # so that equal vectors tie
                order = np.lexsort((number[which], -exact, who))
                who, which, exact = who[order], which[order], exact[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                out.append((at + who[place < k], which[place < k], exact[place < k]))
        who, which, exact = (np.concatenate(x) for x in zip(*out))
        columns = [t.take(pa.array(x)) for t, x in ((wanted_by["query_id"], who), (wanted_by["v"], who), (found["vec_id"], which))]
        return pa.table([*columns, pa.array(exact)], names=["query_id", "q", "vec_id", "score"])

    keys = ["block", "part"]
    found = dealt.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(rerank, "query_id bigint, q array<double>, vec_id bigint, score double")
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
