"""State of patients over time: observations with expiry, as-of resolution, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days of a term, of grace after it, after a delivery; the week assumed where none is known.
TERM, GRACE, AFTER_DELIVERY, ASSUMED_WEEK = 280, 21, 42, 20


def trimester(week: Column) -> Column:
    return F.when(week <= 13, 1).when(week <= 27, 2).when(week.isNotNull(), 3)


def state_observation(obs: DataFrame, term: int = TERM, grace: int = GRACE, after: int = AFTER_DELIVERY) -> DataFrame:
    """Observations with status, due date and expiry; rows that say nothing are dropped.

    obs: pregnant (null: not said), postpartum, ga_weeks, effective_at and more. Postpartum comes first.
    """
    said = F.col("pregnant").isNotNull() | F.col("postpartum") | F.col("ga_weeks").isNotNull()
    pregnant = ~F.col("postpartum") & F.coalesce("pregnant", F.lit(False))
    week = F.coalesce("ga_weeks", F.lit(ASSUMED_WEEK))
    due = F.when(pregnant, F.col("effective_at") + F.make_dt_interval(days=F.lit(term) - 7 * week))
    expires = F.when(F.col("postpartum"), F.col("effective_at") + F.make_dt_interval(days=F.lit(after))).when(pregnant, due + F.make_dt_interval(days=F.lit(grace)))
    status = F.when(F.col("postpartum"), "postpartum").when(pregnant, "pregnant").otherwise("unknown")
    return obs.where(said).withColumns({"status": status, "edd": due, "expires_at": expires})


def is_expired(expires_at: Column, at: Column) -> Column:
    return F.coalesce(at > expires_at, F.lit(False))


def ga_weeks_at(status: Column, weeks: Column, observed: Column, at: Column) -> Column:
    """Weeks carried forward by whole weeks since the observation; only while pregnant and within 1 to 45."""
    now = weeks + F.floor(F.date_diff(at, observed) / 7)
    return F.when((status == "pregnant") & now.between(1, 45), now.cast("int"))


def state_as_of(obs: DataFrame, moments: DataFrame) -> DataFrame:
    """The newest observation at or before each moment; expired or none: unknown.

    obs: patient_id, effective_at, created_at, status, expires_at, ga_weeks. moments: patient_id, moment_id, at. Both go
    through one window per patient ordered by time, observations before moments of the same time, so a patient's rows are
    sorted once and nothing is joined.
    """
    seen = F.struct("status", "expires_at", "ga_weeks", "effective_at")
    a = obs.select("patient_id", F.col("effective_at").alias("t"), F.lit(0).alias("kind"), F.col("created_at").alias("tie"), seen.alias("seen"), F.lit(None).cast("long").alias("moment_id"))
    b = moments.select("patient_id", F.col("at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp").alias("tie"), F.lit(None).cast(a.schema["seen"].dataType).alias("seen"), F.col("moment_id").cast("long").alias("moment_id"))
    last = F.last("seen", ignorenulls=True).over(Window.partitionBy("patient_id").orderBy("t", "kind", "tie"))
    found = a.unionByName(b).withColumn("s", last).where("kind = 1")
    expired = is_expired(F.col("s.expires_at"), F.col("t"))
    status = F.when(F.col("s").isNull() | expired, "unknown").otherwise(F.col("s.status"))
    return found.select("patient_id", "moment_id", F.col("t").alias("at"), status.alias("status"), expired.alias("expired"), ga_weeks_at(status, F.col("s.ga_weeks"), F.col("s.effective_at"), F.col("t")).alias("weeks"))


def effective_context(visits: DataFrame) -> DataFrame:
    """A visit's context: explicit state of the same minute, else the text's, else the prior state; weeks projected.

    visits: visit_id, at, prior_status, prior_source, prior_at, prior_weeks, pregnant, postpartum, week.
    """
    explicit = (F.col("prior_source") == "explicit") & (F.abs(F.unix_timestamp("at") - F.unix_timestamp("prior_at")) <= 60)
    own = F.when(F.col("postpartum"), "postpartum").when(F.col("pregnant"), "pregnant").when(~F.col("pregnant"), "unknown")
    status = F.when(F.coalesce(explicit, F.lit(False)), F.col("prior_status")).otherwise(F.coalesce(own, "prior_status", F.lit("unknown")))
    weeks = F.coalesce("week", ga_weeks_at(status, F.col("prior_weeks"), F.col("prior_at"), F.col("at")))
    return visits.select("visit_id", status.alias("status"), F.when(status == "pregnant", weeks).alias("weeks"), trimester(F.when(status == "pregnant", weeks)).alias("trimester"))


def state_history(obs: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("effective_at", "status")))
    return obs.groupBy("patient_id").agg(F.transform(rows, lambda x: x["status"]).alias("history"), F.count("*").alias("n"))


def recent_history(jobs: DataFrame, k: int = 5) -> DataFrame:
    """For each job the ids of the patient's last k complete ones strictly before it, oldest first.

    One sort of each patient's jobs: complete ones gather over all rows of earlier time, so ties aren't seen.
    """
    seconds = F.unix_micros(F.col("visit_at").cast("timestamp"))
    before = Window.partitionBy("patient_id").orderBy(seconds).rangeBetween(Window.unboundedPreceding, -1)
    # collect_list over a growing frame would be quadratic; ranks among complete jobs and a join on them are not.
    done = jobs.where("status = 'complete'").withColumn("nth", F.row_number().over(Window.partitionBy("patient_id").orderBy("visit_at", "job_id"))).select("patient_id", F.col("job_id").alias("earlier"), "nth")
    seen = jobs.withColumn("upto", F.count_if(F.col("status") == "complete").over(before))
    wanted = seen.select("job_id", "patient_id", F.explode_outer(F.when(F.col("upto") > 0, F.sequence(F.greatest(F.lit(1), F.col("upto") - k + 1), F.col("upto")))).alias("nth"))
    joined = wanted.join(done, ["patient_id", "nth"], "left").groupBy("job_id").agg(F.array_sort(F.collect_list(F.when(F.col("earlier").isNotNull(), F.struct("nth", "earlier")))).alias("h"))
    return joined.select("job_id", F.transform("h", lambda x: x["earlier"]).alias("history"))


def append_state(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)
