"""Queries of filters, projections and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.functions import scores
from visitloom.operators import filters as o
from visitloom.plans.bindings import ITEMS, JOBS, STATES, items, jobs, states
from visitloom.plans.registry import Tables, query

PRIORITY = "round(0.35 * (1 - confidence) + 0.2 * entropy + 0.25 * least(1, 50 * ood / 100) + 0.2 * ood, 4)"


def with_priority(rows: DataFrame) -> DataFrame:
    return rows.withColumn("review_priority", scores.review_priority(F.col("confidence"), F.col("entropy"), F.col("ood") / 100, F.col("ood")))


@query("flt_01", f"with {JOBS} select *, count(*) over () total from jobs where status = 'complete' order by visit_at desc, job_id limit 50 offset 10")
def flt_01(t: Tables) -> DataFrame:
    return o.list_jobs(jobs(t), None, "complete", 50, 10)


@query("flt_02", "select c_custkey, c_name, c_mktsegment from customer where contains(c_name, '42') or contains(c_mktsegment, 'MACH')")
def flt_02(t: Tables) -> DataFrame:
    return o.search(t.customer, ["c_name", "c_mktsegment"], "42").select("c_custkey", "c_name", "c_mktsegment").unionByName(o.search(t.customer, ["c_mktsegment"], "MACH").where(~F.col("c_name").contains("42")).select("c_custkey", "c_name", "c_mktsegment"))


@query("flt_03", "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_orderkey = 7 and l_linenumber = 1")
def flt_03(t: Tables) -> DataFrame:
    return o.lookup(t.lineitem, l_orderkey=7, l_linenumber=1).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("flt_04", f"with {JOBS} select job_id, status, visit_at from jobs where status in ('queued', 'running') order by visit_at, job_id")
def flt_04(t: Tables) -> DataFrame:
    return o.active(jobs(t)).select("job_id", "status", "visit_at").orderBy("visit_at", "job_id")


@query("flt_05", "select doc_id, d.source from documents d left join (select doc_id, max(toxic) toxic from labels group by 1) l using (doc_id) where toxic is null")
def flt_05(t: Tables) -> DataFrame:
    marks = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return o.pending(t.documents.select("doc_id", "source").join(marks, "doc_id", "left"), "toxic").select("doc_id", "source")


@query("flt_06", f"with {STATES} select event_id, kind, pregnant from states where pregnant is null or pregnant <> true")
def flt_06(t: Tables) -> DataFrame:
    return o.exclude_or_null(states(t), "pregnant", True).select("event_id", "kind", "pregnant")


@query("flt_07", "select event_id, ts from events where ts >= timestamp '2024-01-09 23:00:00' and ts < timestamp '2024-01-10 23:00:00'")
def flt_07(t: Tables) -> DataFrame:
    start, end = o.local_day_bounds("Europe/Paris", F.lit("2024-01-10 12:00:00").cast("timestamp"))
    return t.events.where((F.col("ts") >= start) & (F.col("ts") < end)).select("event_id", "ts")


@query("flt_08", f"with {JOBS} select job_id, case when price > 400000 then 'approved' when status = 'complete' then 'pending_review' when status = 'running' then 'in_progress' when severity = '1-URGENT' then 'warning' else status end shown from jobs")
def flt_08(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", o.dashboard_status(F.col("price") > 400000, F.col("status"), F.col("severity") == "1-URGENT").alias("shown"))


@query("flt_09", f"with {JOBS} select job_id, coalesce(case when status = 'complete' then visit_at end, case when status = 'running' then visit_at + interval 1 day end, timestamp '2000-01-01') clinical_at, case when floor(price)::bigint % 3 = 0 then 1.0 else (floor(price)::bigint % 3)::double end score from jobs")
def flt_09(t: Tables) -> DataFrame:
    at = o.first_said(F.when(F.col("status") == "complete", F.col("visit_at")), F.when(F.col("status") == "running", F.col("visit_at") + F.expr("interval 1 day")), F.lit("2000-01-01").cast("timestamp"))
    return jobs(t).select("job_id", at.alias("clinical_at"), o.truthy_or((F.floor("price") % 3).cast("double"), F.lit(1.0)).alias("score"))


@query("flt_10", "select c_custkey, c_name from customer where c_acctbal >= 0")
def flt_10(t: Tables) -> DataFrame:
    gone = t.customer.withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("timestamp")))
    return o.alive(gone).select("c_custkey", "c_name")


@query("flt_11", f"with {JOBS} select job_id, patient_id, status from jobs where patient_id = 11")
def flt_11(t: Tables) -> DataFrame:
    return o.scoped(jobs(t), "patient_id", 11).select("job_id", "patient_id", "status")


@query("flt_12", f"with {ITEMS} select item_id, text from items where not is_corrected and not is_suspect and trim(text) <> ''")
def flt_12(t: Tables) -> DataFrame:
    return o.real_sentences(items(t)).select("item_id", "text")


@query("flt_13", f"with {ITEMS} select item_id, {PRIORITY} review_priority from items where not is_corrected and {PRIORITY} > 0")
def flt_13(t: Tables) -> DataFrame:
    return o.confirmed(with_priority(items(t))).select("item_id", "review_priority")


@query("prj_01", f"with {ITEMS} select job_id, order_index, item_id from items")
def prj_01(t: Tables) -> DataFrame:
    return items(t).select("job_id", "order_index", o.item_id(F.col("job_id"), F.col("order_index")).alias("item_id"))


@query("prj_02", "select o_orderkey, greatest(0, date_diff('year', date '1970-06-15', o_orderdate::date) - ((month(o_orderdate), day(o_orderdate)) < (6, 15))::int)::int age from orders")
def prj_02(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", o.age_years(F.lit("1970-06-15").cast("date"), F.to_date("o_orderdate")).alias("age"))


@query("prj_03", "select o_orderkey job, c_name patient, o_orderdate visit_at from orders left join customer on o_custkey = c_custkey")
def prj_03(t: Tables) -> DataFrame:
    outward = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("patient"))
    return t.orders.select(F.col("o_orderkey").alias("job"), "o_custkey", F.col("o_orderdate").alias("visit_at")).join(outward, "o_custkey", "left").drop("o_custkey")


def corrections(t: Tables) -> DataFrame:
    """Corrected items' edits: the label before and after."""
    return items(t).where("is_corrected and label <> new_label").select("item_id", "job_id", F.lit("label").alias("field"), F.col("label").alias("old_value"), F.col("new_label").alias("new_value"), F.col("corrected_at").alias("created_at"))


CORRECTIONS = f"{ITEMS}, corrections as (select item_id, job_id, 'label' field, label old_value, new_label new_value, corrected_at created_at from items where is_corrected and label <> new_label)"


@query("prj_04", f"with {CORRECTIONS} select item_id, text, new_value as label, old_value predicted, created_at, 'human' as source from corrections join items using (item_id)")
def prj_04(t: Tables) -> DataFrame:
    return o.training_rows(corrections(t), items(t))


@query("prj_05", f"with {ITEMS} select item_id, text, label, confidence from items order by confidence nulls first, item_id limit 40")
def prj_05(t: Tables) -> DataFrame:
    return o.gold_draft(items(t), 40)


@query("top_01", f"with {ITEMS} select * from (select item_id, job_id, {PRIORITY} review_priority, (row_number() over (partition by job_id order by {PRIORITY} desc nulls last, confidence, item_id))::int as rank from items where not is_corrected) where rank <= 3")
def top_01(t: Tables) -> DataFrame:
    return o.review_queue(with_priority(items(t)), 3, per_job=True).select("item_id", "job_id", "review_priority", "rank")


RANKS = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}
RANK = "case severity when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 else 99 end"


@query("top_02", f"with {JOBS} select job_id, severity, {RANK} severity_rank from jobs order by 3, 1")
def top_02(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", "severity", o.severity_rank(F.col("severity"), RANKS).alias("severity_rank")).orderBy("severity_rank", "job_id")


@query("top_03", f"with {JOBS} select job_id, patient_id, visit_at from (select *, row_number() over (partition by patient_id order by visit_at desc, job_id desc) r from jobs where status <> 'complete') where r <= 4")
def top_03(t: Tables) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("patient_id").orderBy(F.col("visit_at").desc(), F.col("job_id").desc()))
    return jobs(t).where("status <> 'complete'").withColumn("r", newest).where("r <= 4").select("job_id", "patient_id", "visit_at")


@query("top_04", f"with {JOBS} select job_id, visit_at from jobs order by visit_at desc, job_id desc limit 5")
def top_04(t: Tables) -> DataFrame:
    return o.page(jobs(t).select("job_id", "visit_at"), [F.col("visit_at").desc(), F.col("job_id").desc()], 5)


@query("top_05", "select c_custkey, c_name from customer order by c_name, c_custkey limit 25 offset 25")
def top_05(t: Tables) -> DataFrame:
    return o.page(t.customer.select("c_custkey", "c_name"), [F.col("c_name"), F.col("c_custkey")], 25, 25)


@query("top_06", "select d.doc_id, quality from documents d left join (select doc_id, max(quality) quality from labels group by 1) l using (doc_id) order by quality nulls first, d.doc_id limit 60")
def top_06(t: Tables) -> DataFrame:
    seen = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return o.page(t.documents.select("doc_id").join(seen, "doc_id", "left"), [F.col("quality").asc_nulls_first(), F.col("doc_id")], 60)
