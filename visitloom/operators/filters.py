"""Filters, projections and ordered pages over keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in an order that has no ties."""
    return df.orderBy(*order).offset(offset).limit(limit)


def equal_or_any(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal each wanted value; None asks for nothing."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == F.lit(kv[1])), wanted.items(), df)


def list_jobs(jobs: DataFrame, patient: int | None, status: str | None, limit: int, offset: int = 0) -> DataFrame:
    """A page of jobs, newest first, with the number of all that match."""
    kept = equal_or_any(jobs, patient_id=patient, status=status)
    total = kept.agg(F.count("*").alias("total"))
    return page(kept, [F.col("visit_at").desc(), F.col("job_id")], limit, offset).crossJoin(F.broadcast(total))


def search(df: DataFrame, cols: list[str], q: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).contains(q) for c in cols]))


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()]))


def active(jobs: DataFrame, states: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    return jobs.where(F.col("status").isin(*states))


def pending(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def exclude_or_null(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows that don't have the value; null stays."""
    return df.where(F.col(column).isNull() | (F.col(column) != F.lit(value)))


def local_day_bounds(zone: str, now: Column) -> tuple[Column, Column]:
    """The first moment of the zone's day that holds now, and of the next, in UTC; an unknown zone is UTC."""
    from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

    try:
        ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError):
        zone = "UTC"
    day = F.date_trunc("day", F.from_utc_timestamp(now, zone))
    return F.to_utc_timestamp(day, zone), F.to_utc_timestamp(day + F.expr("interval 1 day"), zone)


def dashboard_status(finalized: Column, status: Column, warned: Column) -> Column:
    return F.when(finalized, "approved").when(status == "complete", "pending_review").when(status == "running", "in_progress").when(warned, "warning").otherwise(status)


def first_said(*cols: Column) -> Column:
    return F.coalesce(*cols)


def truthy_or(a: Column, b: Column) -> Column:
    """a unless it is null or zero."""
    return F.when(a.isNull() | (a == 0), b).otherwise(a)


def alive(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def scoped(df: DataFrame, owner_column: str, owner: object) -> DataFrame:
    return df.where(F.col(owner_column) == F.lit(owner))


def real_sentences(items: DataFrame) -> DataFrame:
    """Items fit for learning: not corrected, not suspect, with text."""
    return items.where(~F.col("is_corrected") & ~F.col("is_suspect") & (F.trim("text") != ""))


def confirmed(items: DataFrame) -> DataFrame:
    return items.where(~F.col("is_corrected") & F.col("review_priority").isNotNull() & (F.col("review_priority") > 0))


def item_id(job: Column, order: Column) -> Column:
    return F.concat_ws("-", job.cast("string"), F.lpad(order.cast("string"), 4, "0"))


def age_years(birth: Column, at: Column) -> Column:
    """Completed years at a date, never below 0."""
    before = (F.month(at) < F.month(birth)) | ((F.month(at) == F.month(birth)) & (F.dayofmonth(at) < F.dayofmonth(birth)))
    return F.greatest(F.lit(0), F.year(at) - F.year(birth) - before.cast("int"))


def training_rows(corrections: DataFrame, items: DataFrame) -> DataFrame:
    """Text, the new label, what was predicted, when, and that a human said so."""
    return corrections.join(items.select("item_id", "text"), "item_id").select("item_id", "text", F.col("new_value").alias("label"), F.col("old_value").alias("predicted"), "created_at", F.lit("human").alias("source"))


def gold_draft(items: DataFrame, n: int, uncertain_first: bool = True) -> DataFrame:
    order = [F.col("confidence").asc_nulls_first()] if uncertain_first else []
    return items.select("item_id", "text", "label", "confidence").orderBy(*order, "item_id").limit(n)


def review_queue(items: DataFrame, n: int, per_job: bool = False) -> DataFrame:
    """Uncorrected items, highest priority first with null last, then least confident; n in all or of each job."""
    open_ = items.where(~F.col("is_corrected"))
    order = [F.col("review_priority").desc_nulls_last(), F.col("confidence").asc(), F.col("item_id")]
    if not per_job:
        return open_.orderBy(*order).limit(n)
    return open_.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(*order))).where(F.col("rank") <= n)


def severity_rank(severity: Column, ranks: dict[str, int], last: int = 99) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(known[severity], F.lit(last))
