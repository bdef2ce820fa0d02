"""Windowed report counts as streams. The batch forms are in storyloom.operators.early_warning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subject_counts(reports: DataFrame, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts and sums by subject and window of a streaming (or batch) frame of reports; rows later than `late` are left out."""
    own = reports.withWatermark("ts", late) if reports.isStreaming else reports
    out = own.groupBy(F.window("ts", window), "subject").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), "subject", "n", "value")


def first_reports(reports: DataFrame, late: str = "1 hour") -> DataFrame:
    """Reports without those whose id came before, within the watermark."""
    return reports.withWatermark("ts", late).dropDuplicatesWithinWatermark(["report_id"]) if reports.isStreaming else reports.dropDuplicates(["report_id"])
