"""Relationships kept up to date from batches of new articles.

The state in a folder is pairs (a, b, n, sources, last), the sources seen, and the signals sent. A batch's own pairs are
counted and merged with it by key; nothing old is counted again. Two copies of the state take turns: batch N reads
that of N - 1 and overwrites that of N - 2, so a batch that is run again after a failure, with its id, gives the
same state. Signals are a table by batch for the same reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import graph
from storyloom.sources import tables as tb

PAIRS = "a long, b long, n long, sources array<long>, last timestamp"
SIGNALS = "a long, b long, kind string, severity string, n long, before long, created_at timestamp"
#: Articles of a strong pair, the strength of a new one worth a signal, and growth that is a surge.
STRONG, NEW, SURGE = 3, 0.35, 2.0


def deltas(links: DataFrame) -> DataFrame:
    """PAIRS of new articles alone: article_id, entity_id, source_id, published_at; an article comes in one batch."""
    pairs = tb.dealt(graph.article_pairs(links), links, "a", "b").groupBy("a", "b")
    return pairs.agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("s"))).alias("sources"), F.max("last").alias("last"))


def merged(state: DataFrame, new: DataFrame) -> DataFrame:
    """PAIRS and `before`, the count that a pair had: those of both, added up."""
    old = state.select("a", "b", *[F.col(c).alias(f"old_{c}") for c in ("n", "sources", "last")])
    both = old.join(new, ["a", "b"], "full")
    none = F.expr("cast(array() AS array<long>)")
    return both.select(
        "a", "b", (F.coalesce("old_n", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"),
        F.array_union(F.coalesce("old_sources", none), F.coalesce("sources", none)).alias("sources"), F.greatest("old_last", "last").alias("last"),
        F.coalesce("old_n", F.lit(0)).alias("before"), F.col("n").isNotNull().alias("touched"),
    )


def current(pairs: DataFrame, sources: DataFrame, as_of: Column, least: int = 2) -> DataFrame:
    """What graph.relationships gives for all articles so far."""
    return graph.scored(pairs.withColumn("sources", F.size("sources")), sources.agg(F.count("*").alias("all_sources")), as_of, least)


def signals(pairs: DataFrame, sources: DataFrame, sent: DataFrame, as_of: Column) -> DataFrame:
    """SIGNALS of merged pairs: new ones of three articles and some strength, and known ones that grew threefold, but none
    that was sent in the last 24 hours."""
    marked = current(pairs, sources, as_of).join(pairs.where("touched").select("a", "b", "before"), ["a", "b"])
    new = (F.col("before") == 0) & (F.col("n") >= STRONG) & (F.col("strength") >= NEW)
    surge = (F.col("before") > 0) & (F.col("n") >= STRONG) & (F.col("n") - F.col("before") >= SURGE * F.col("before"))
    found = marked.select("a", "b", F.when(new, "new_relationship").when(surge, "unusual_pair").alias("kind"), F.when(new, "medium").otherwise("high").alias("severity"), "n", "before", as_of.alias("created_at")).where("kind IS NOT NULL")
    recent = sent.where(F.col("created_at") >= as_of - F.expr("INTERVAL 24 HOURS")).select("a", "b", "kind").distinct()
    return found.join(recent, ["a", "b", "kind"], "left_anti").select("a", "b", "kind", "severity", "n", "before", "created_at")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def state(spark: SparkSession, folder: str, batch: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, sources) after a batch."""
    slot = batch % 2
    return _read(spark, f"{folder}/pairs-{slot}", PAIRS), _read(spark, f"{folder}/sources-{slot}", "source_id long")


def sent(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/signals", f"{SIGNALS}, batch long")


def keep(folder: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: merges each batch of links into the state in the folder and adds its signals.

    A batch's time is that of its latest article. The folder belongs to the stream's checkpoint: batch ids go on
    where they were. A batch without links only hands the state on.
    """

    def run(links: DataFrame, batch: int) -> None:
        spark = links.sparkSession
        pairs, sources = state(spark, folder, batch - 1) if batch else (spark.createDataFrame([], PAIRS), spark.createDataFrame([], "source_id long"))
        now = merged(pairs, deltas(links))
        seen = sources.unionByName(links.select(F.col("source_id").cast("long").alias("source_id")).where("source_id IS NOT NULL")).distinct()
        seen.write.mode("overwrite").parquet(f"{folder}/sources-{batch % 2}")
        now.write.mode("overwrite").parquet(f"{folder}/pairs-{batch % 2}")
        latest = links.agg(F.max("published_at")).first()[0]
        kept = spark.read.parquet(f"{folder}/pairs-{batch % 2}")
        before = sent(spark, folder).where(F.col("batch") < batch)
        found = signals(kept, state(spark, folder, batch)[1], before, F.lit(latest).cast("timestamp"))
        found.write.mode("overwrite").parquet(f"{folder}/signals/batch={batch}")

    return run
