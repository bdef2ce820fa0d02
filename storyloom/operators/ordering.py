"""Work that depends on an order: the latest earlier post of a key, stretches of time, and components of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.sources import tables as tb


def latest_before(posts: DataFrame, asks: DataFrame, seconds: int) -> DataFrame:
    """asks with found (ts, id): the latest post of the ask's key before it in (ts, id), or null.

    posts have key, ts, id; asks have key, ts, id and any more. A post counts if it is at most `seconds` older than
    the ask. Of each key a span of `seconds` is one group, which gets the last post of the span before, so a key of
    many posts is dealt over its spans; no post meets an ask but its nearest.
    """
    span = (F.unix_timestamp("ts") / seconds).cast("long").alias("span")
    more = [c for c in asks.columns if c not in ("key", "ts", "id")]
    held = posts.select("key", span, F.struct("ts", "id").alias("post"))
    last = held.groupBy("key", "span").agg(F.max("post").alias("post")).withColumn("span", F.col("span") + 1)
    asked = asks.select("key", span, F.struct("ts", "id").alias("at"), F.struct("key", *more).alias("ask") if more else F.struct("key").alias("ask"))
    none = F.lit(None)
    rows = (
        held.select("key", "span", F.col("post").alias("at"), "post", none.cast(asked.schema["ask"].dataType).alias("ask"))
        .unionByName(last.select("key", "span", F.col("post").alias("at"), "post", none.cast(asked.schema["ask"].dataType).alias("ask")))
        .unionByName(asked.select("key", "span", "at", none.cast(held.schema["post"].dataType).alias("post"), "ask"))
    )
    # An ask comes before a post of the same place, so that an article doesn't find itself.
    before = Window.partitionBy("key", "span").orderBy("at", F.col("ask").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("found", F.last("post", ignorenulls=True).over(before)).where("ask IS NOT NULL")
    near = F.unix_timestamp("at.ts") - F.unix_timestamp("found.ts") <= seconds
    return found.select("ask.*", "at.ts", "at.id", F.when(near, F.col("found")).alias("found"))


def stretches(rows: DataFrame, seconds: int, most: int = 8000, of: DataFrame | None = None) -> DataFrame:
    """rows (at, id, ...; at in microseconds) with stretch, i, j, asks and posts: an asking and a posting row meet in
    exactly one group (stretch, i, j) if the latter is at most `seconds` older, and may do so if it isn't.

    A stretch of time is three times as long, and gets the last rows of the one before, which only post. Rows of a stretch
    with more than `most` are dealt into parts, and every two parts are a group: no group grows with the table.
    Some rows of a table (of) are dealt like that whole table.
    """
    long = 3_000_000 * seconds
    own = F.floor(F.col("at") / long)
    late = F.col("at") >= (own + 1) * long - 1_000_000 * (seconds + 1)
    placed = F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))
    parts = (rows if of is None else of).select(placed.alias("stretch")).groupBy("stretch").agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = rows.select("*", own.alias("own"), placed.alias("stretch")).join(F.broadcast(parts), "stretch")  # one row for each stretch
    dealt = dealt.withColumns({"part": F.pmod(F.xxhash64("id"), F.col("parts")), "home": F.col("own") == F.col("stretch")})
    group = lambda i, j, asks, posts: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), posts.alias("posts"))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    posting = F.transform(every, lambda k: group(k, F.col("part"), F.col("home") & (k == F.col("part")), F.lit(True)))
    asking = F.transform(F.filter(every, lambda k: F.col("home") & (k != F.col("part"))), lambda k: group(F.col("part"), k, F.lit(True), F.lit(False)))
    return dealt.select(*rows.columns, "stretch", F.explode(F.concat(posting, asking)).alias("g")).select(*rows.columns, "stretch", "g.*")


class Sets:
    """Disjoint sets of nodes, each named by its smallest node."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, node: int) -> int:
        above = self.above
        while (up := above.setdefault(node, node)) != node:
            above[node] = node = above[up]
        return node

    def join(self, a: int, b: int) -> bool:
        """Whether the two nodes were in different sets."""
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A link from each node to the smallest one that the links of a task let it reach."""
    held, kind = Sets(), None
    for batch in batches:
        kind = batch.schema.types[0]
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.join(a, b)
    found = [(n, held.root(n)) for n in list(held.above)]
    for first in range(0, len(found), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found[first : first + 10_000]], kind) for k in (0, 1)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b), root the smallest node reachable.

    Links of whole numbers are first dealt by ranges of their nodes, and those of a task made into stars, so that a chain
    along the ids is no longer than there are ranges. Then rounds of two steps: a node takes the smallest root among its neighbours, then
    that root's own root. Each round is joins and grouped minima over the links, written to the shared folder.
    """
    kind = links.schema["a"].dataType.simpleString()
    stars = links.select("a", "b")
    if kind in ("int", "bigint"):
        stars = tb.written(stars.repartitionByRange("a").mapInArrow(_stars, f"a {kind}, b {kind}"))
    both = tb.written(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    now = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
    while True:
        now = tb.written(now)
        around = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("around"))
        least = now.join(around, "node").select("node", F.col("root").alias("before"), F.least("root", "around").alias("next"))
        jump = now.select(F.col("node").alias("next"), F.col("root").alias("jump"))
        after = tb.written(least.join(jump, "next").select("node", "before", F.least("next", "jump").alias("root")))
        now = after.select("node", "root")
        if after.where("root != before").isEmpty():
            return now
