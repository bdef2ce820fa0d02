from pyspark.sql import functions as F

from storyloom.sources import tables as tb
from storyloom.streaming import windows


def test_stream_counts_equal_batch_counts(spark, sf, tmp_path):
    reports = tb.reports(spark, sf).select("report_id", "ts", "subject", "value")
    reports.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reports.schema).parquet(str(tmp_path / "in"))
    query = windows.subject_counts(stream).writeStream.outputMode("complete").format("memory").queryName("subject_counts").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.start, r.subject): r.n for r in spark.table("subject_counts").collect()}
    assert got == {(r.start, r.subject): r.n for r in windows.subject_counts(reports).collect()}


def test_repeated_reports_are_dropped(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "report_id long, subject string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windows.first_reports(stream).writeStream.outputMode("append").format("memory").queryName("first_reports").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("first_reports").count() == 2 == windows.first_reports(rows).count()
