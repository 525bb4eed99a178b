"""Writers: training lines, review sheets, exported reports."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_training(df: DataFrame, path: str, source: str) -> None:
    df.select("text", "label", F.lit(source).alias("source")).write.json(path)


def write_review_csv(df: DataFrame, path: str) -> None:
    df.withColumn("decision", F.lit("")).write.option("header", True).option("quoteAll", True).csv(path)


def write_reports(reports: DataFrame, path: str, per_file: int = 256) -> None:
    """Reports (job_id and what else they hold) as JSON documents, a file each, that list about per_file reports.

    Making a file costs far more than a report's bytes. Which file a report goes to hangs on its job alone, so that tasks
    that run again write the same lists.
    """
    files = max(1, ceil(reports.count() / per_file))
    lists = reports.groupBy(F.pmod(F.xxhash64("job_id"), F.lit(files)).alias("file")).agg(F.to_json(F.collect_list(F.struct(*reports.columns))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)


def export_reports(items: DataFrame, fired: DataFrame, path: str) -> None:
    """A JSON document a line for each report with its items and rules, in a folder for each day."""
    reports(items, fired).write.partitionBy("day").text(path)


def reports(items: DataFrame, fired: DataFrame) -> DataFrame:
    """value (the document) and day of each report. items: job_id, day, order_index, text, label. fired: job_id, rule_id."""
    a = items.groupBy("job_id", "day").agg(F.array_sort(F.collect_list(F.struct("order_index", "text", "label"))).alias("items"))
    b = fired.groupBy("job_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    return a.join(b, "job_id", "left").select(F.to_json(F.struct("job_id", "items", F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))).alias("value"), "day")
