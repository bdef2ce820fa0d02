"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source, each gets the fractional rank
(rank - 1/2) / rows of its source, and all rows are put in the order of that fraction and cut into equal
runs. A run then holds every source in its share of the whole, and runs differ by one row at most.

Both ranks are exact and neither is made in one task: rows are dealt into cells by a range of the sort key,
a cell's rows are ranked by a window over that cell, and the sums of the preceding cells' counts are added.
A source that holds a third of all rows is spread over as many cells as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm._common import quoted


def shuffle_key(*parts: Column, seed: int = 7) -> Column:
    """A seeded hash of the parts as 32 hexadecimal digits, whose order is the shuffled order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _prefix(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds `before`: the sum of `n` over the preceding cells of the same group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def interleave(df: DataFrame, source: str, key: str, n_shards: int = 16, rows_per_cell: int = 20_000) -> DataFrame:
    """df with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 within a shard).

    `key` names a column of at least 8 leading hexadecimal digits that gives the shuffled order (see
    shuffle_key). A null source is a stratum of its own, the same as an empty one; equal keys keep any order
    (their rows are equal if the key covers the row). Input columns named `shard` or `slot` are replaced. An
    empty table gives no rows.
    """
    total = df.count()
    cells = max(1, -(-total // rows_per_cell))
    h = quoted(df, key)
    packed = df.select(
        F.struct(*[quoted(df, c).alias(c) for c in df.columns]).alias("row"),
        F.coalesce(quoted(df, source).cast("string"), F.lit("")).alias("src"),
        h.alias("h"),
        ((F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * cells) / F.lit(1 << 32)).cast("long").alias("cell"),
    )
    counts = packed.groupBy("src", "cell").agg(F.count("*").alias("n"))
    counts = _prefix(counts, ["src"], "cell").withColumn("of", F.sum("n").over(Window.partitionBy("src")))
    within = Window.partitionBy("src", "cell").orderBy("h")
    ranked = (
        packed.withColumn("r", F.row_number().over(within))
        .join(counts.select("src", "cell", "before", "of"), ["src", "cell"])
        .withColumn("rank", F.col("before") + F.col("r"))
        .withColumn("fraction", (F.col("rank") - 0.5) / F.col("of"))
        .withColumn("band", F.expr(f"({cells}L * (2L * rank - 1L)) div (2L * of)"))
        .select("row", "src", "fraction", "band", "h")
    )
    bands = _prefix(ranked.groupBy("band").agg(F.count("*").alias("n")), [], "band")
    place = Window.partitionBy("band").orderBy("fraction", "src", "h")
    total = max(total, 1)
    placed = (
        ranked.withColumn("r", F.row_number().over(place))
        .join(bands.select("band", "before"), "band")
        .withColumn("at", F.col("before") + F.col("r") - 1)
        .withColumn("shard", F.expr(f"(at * {n_shards}L) div {total}L").cast("int"))
        .withColumn("slot", F.expr(f"at - ((shard * {total}L + {n_shards - 1}L) div {n_shards}L)"))
    )
    keep = [F.col("row")[c].alias(c) for c in df.columns if c not in ("shard", "slot")]
    return placed.select(*keep, "shard", "slot")
