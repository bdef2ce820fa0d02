"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; the edge table, never a component, is what a task holds. The
minimum is pre-aggregated before its shuffle and the join's only large side can be split by Spark's skew
join, so a node with very many neighbours is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm._common import cut


def _pairs(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Several (u, v) rows for each edge, without those of equal ends."""
    made = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    return edges.select(F.explode(made).alias("e")).select("e.u", "e.v").where("u != v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _pairs(edges, ("u", "v"), ("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _pairs(down.join(least, "u"), ("v", "m"), ("u", "m")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node it is connected with.

    Nodes are of any type with an order. Edges may repeat, run either way or be loops (which say nothing);
    edges with a null end are left out. No edges give no rows.
    """
    stars = cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v").distinct())
    before = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        stars = cut(_small_star(_large_star(stars)))
    named = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))
    return stars.select(F.explode(named).alias("n")).select("n.*").distinct()
