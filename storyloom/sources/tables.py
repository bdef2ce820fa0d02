"""The engine's tables, derived from the given ones, and the same derivations in SQL for the oracles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """df written to the folder that the cluster shares (spark.checkpoint.dir) and read again, so its lineage ends there."""
    path = _path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, of: DataFrame, *keys: str, most: int = 250_000) -> DataFrame:
    """df partitioned by the keys, over one more partition for each `most` rows of the table that it is made from, so that
    what a task holds doesn't grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-of.count() // most)), *keys)


def _path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


class Grown:
    """A table in the shared folder that grows by parts and is read as one."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.schema, self.path, self.parts = spark, schema, _path(spark), 0

    def add(self, part: DataFrame) -> None:
        part.write.mode("append").parquet(self.path)
        self.parts += 1

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self.parts else self.spark.createDataFrame([], self.schema)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, title (first line), content, language, source, published_at (seven minutes apart)."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("article_id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 500).alias("title"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        "source",
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id * 7 AS int), 0)").alias("published_at"),
    )


ARTICLES = """articles AS (SELECT doc_id AS article_id, substr(string_split(text, chr(10))[1], 1, 500) AS title, text AS content, lang AS language, source,
  TIMESTAMP '2024-01-01' + doc_id * INTERVAL 7 MINUTE AS published_at FROM documents)"""


def article_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, entity_id, source_id, mention_count, published_at from order lines."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("article_id"),
        F.col("l_partkey").alias("entity_id"),
        F.col("l_suppkey").alias("source_id"),
        F.col("l_quantity").alias("mention_count"),
        F.col("l_shipdate").cast("timestamp").alias("published_at"),
    )


LINKS = """links AS (SELECT l_orderkey AS article_id, l_partkey AS entity_id, l_suppkey AS source_id, l_quantity AS mention_count,
  l_shipdate::TIMESTAMP AS published_at FROM lineitem)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of reports: report_id, ts, subject (kind of event), source_id (user), value, country (of the user's nation)."""
    nations = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    events = read(spark, sf_dir, "events")
    return events.join(nations, (F.col("user_id") % 25) == F.col("n_nationkey")).select(
        F.col("event_id").alias("report_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("subject"), F.col("user_id").alias("source_id"), "value", "country"
    )


REPORTS = """reports AS (SELECT event_id AS report_id, ts::TIMESTAMP AS ts, event_type AS subject, user_id AS source_id, value, n_name AS country
  FROM events JOIN nation ON user_id % 25 = n_nationkey)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located events: one for each report, at a point of the user's nation moved by the report's number."""
    return reports(spark, sf_dir).withColumn("lat", F.expr("cast((source_id * 7) % 180 - 90 AS double) + 0.25 + (report_id % 8) * 0.125")).withColumn(
        "lon", F.expr("cast((source_id * 13) % 360 - 180 AS double) + 0.25 + (report_id % 16) * 0.0625")
    )


PLACES = """places AS (SELECT *, ((source_id * 7) % 180 - 90)::DOUBLE + 0.25 + (report_id % 8) * 0.125::DOUBLE AS lat,
  ((source_id * 13) % 360 - 180)::DOUBLE + 0.25 + (report_id % 16) * 0.0625::DOUBLE AS lon FROM reports)"""
