"""Queries that go through files: what sources read back of what sinks wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.operators.rules import evaluate
from visitloom.plans.bindings import ITEMS, SEGMENTS, STATES, items, segments, states
from visitloom.plans.joins import OBSERVED, observed, visit_facts
from visitloom.plans.registry import Tables, query
from visitloom.plans.updates import _rules
from visitloom.sources import readers as r
from visitloom.sources import writers as w
from visitloom.streaming.state import OUTPUT, daily_counts, state_changes


def scratch(t: Tables, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    sc = t.spark.sparkContext
    top = sc.getCheckpointDir() or t.spark.conf.get("spark.checkpoint.dir", None)
    if not top and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = top or tempfile.mkdtemp(prefix="visitloom-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("src_01", "select md5(text) digest, source as label, 'table' as source from documents where text is not null")
def src_01(t: Tables) -> DataFrame:
    path = scratch(t, "labelled")
    w.write_training(t.documents.select("text", F.col("source").alias("label")), path, "table")
    return r.read_labelled(t.spark, path).select(F.md5("text").alias("digest"), "label", "source")


def _reports(t: Tables) -> DataFrame:
    item = F.struct(F.concat_ws("-", F.col("job_id").cast("string"), F.lpad(F.col("order_index").cast("string"), 4, "0")).alias("item_id"), F.col("order_index").cast("int").alias("order_index"), "text", F.col("speaker").alias("label"), (F.length("text") % 10 / 10).alias("confidence"))
    per = segments(t).groupBy("job_id", F.col("speaker").alias("section")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    soap = F.map_from_entries(F.collect_list(F.struct("section", F.struct("items"))))
    return per.groupBy("job_id").agg(F.create_map(F.lit("age_years"), F.max(F.size("items")).cast("string")).alias("patient_info"), F.array(F.struct(F.lit("turns").alias("code"), F.sum(F.size("items")).cast("string").alias("value"))).alias("clinical_facts"), soap.alias("soap")).withColumn("job_id", F.col("job_id").cast("string"))


@query("src_02", "select count(distinct conv_id)::bigint reports, 0::bigint unreadable from conversations")
def src_02(t: Tables) -> DataFrame:
    path = scratch(t, "reports")
    w.write_reports(_reports(t).select("job_id", "patient_info", "clinical_facts", "soap"), path)
    return r.report_rows(t.spark, path).agg(F.count_if("readable").alias("reports"), F.count_if("unreadable").alias("unreadable"))


@query("src_03", f"with {SEGMENTS} select job_id::varchar job_id, speaker section, order_index::int order_index, job_id || '-' || lpad(order_index::varchar, 4, '0') item_id, md5(text) digest, speaker as label from segments")
def src_03(t: Tables) -> DataFrame:
    return r.report_items(_reports(t)).select("job_id", "section", "order_index", "item_id", F.md5("text").alias("digest"), "label")


@query("src_04", "with n as (select conv_id, role, count(*) k from conversations group by 1, 2) select conv_id::varchar job_id, 'list' origin, 'turns' code, sum(k)::varchar as value, conv_id || '-list-0' fact_id from n group by conv_id union all select conv_id::varchar, 'map', 'age_years', max(k)::varchar, conv_id || '-map-0' from n group by conv_id")
def src_04(t: Tables) -> DataFrame:
    return r.structured_facts(_reports(t))


@query("src_06", "select md5(text) digest, 'keep' decision from benchmark where item_id % 2 = 0")
def src_06(t: Tables) -> DataFrame:
    path = scratch(t, "decisions")
    rows = t.benchmark.select(F.regexp_replace("text", r"[\n\"\\]", " ").alias("text"), F.when(F.col("item_id") % 2 == 0, "keep").otherwise("").alias("decision"))
    rows.write.option("header", True).csv(path)
    kept = r.read_decisions(t.spark, path)
    own = t.benchmark.select("text", F.regexp_replace("text", r"[\n\"\\]", " ").alias("flat"))
    return own.join(kept.withColumnRenamed("text", "flat"), "flat").select(F.md5("text").alias("digest"), "decision")


@query("src_07", """with a as (select trim(text, ' ') as text, 0 part, doc_id seen from documents union all select trim(text, ' '), 1, item_id from benchmark union all select trim(text, ' '), 2, conv_id * 1000 + turn from conversations)
  select md5(text) digest, arg_min(part, (part, seen))::int part, arg_min(seen, (part, seen))::bigint "at" from a where text <> '' group by text""")
def src_07(t: Tables) -> DataFrame:
    got = r.collect_corpus(t.documents.select("text", F.col("doc_id").alias("at")), t.benchmark.select("text", F.col("item_id").alias("at")), t.conversations.select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("at")))
    return got.select(F.md5("text").alias("digest"), "part", "at")


@query("src_08", "select 'orders' name, count(*)::bigint n from orders union all select 'lineitem', count(*) from lineitem union all select 'documents', count(*) from documents union all select 'events', count(*) from events")
def src_08(t: Tables) -> DataFrame:
    out = None
    for name in ("orders", "lineitem", "documents", "events"):
        one = getattr(t, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("src_09", "select md5(text) digest, 'gold' as label from benchmark where item_id % 3 > 0")
def src_09(t: Tables) -> DataFrame:
    path = scratch(t, "gold")
    t.benchmark.select("text", F.when(F.col("item_id") % 3 > 0, "gold").alias("label")).write.json(path)
    return r.read_gold(t.spark, path).select(F.md5("text").alias("digest"), "label")


@query("src_10")
def src_10(t: Tables) -> DataFrame:
    files = r.read_archive(t.spark, f"{t.folder}/labels.parquet")
    catalog = files.select("sha256", "path", F.lit(None).cast("timestamp").alias("verified_at"))
    return r.verify_archive(files, catalog, 100).select("sha256", "status")


@query("src_11", f"with {SEGMENTS} select job_id, order_index::int order_index, md5(text) digest, (order_index * 10)::double start from segments")
def src_11(t: Tables) -> DataFrame:
    rows = segments(t)
    one = F.struct("text", (F.col("order_index") * 10).cast("double").alias("start"), (F.col("order_index") * 10 + 5).cast("double").alias("end"), F.lit(-0.2).alias("avg_logprob"))
    raw = rows.groupBy("job_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("order_index", one.alias("s")))), lambda x: x["s"]).alias("segments"))).alias("raw"))
    return r.transcript_raw(raw).select("job_id", "order_index", F.md5("text").alias("digest"), "start")


@query("sink_01", f"with {ITEMS} select text, new_label as label, 'human' as source from items where is_corrected")
def sink_01(t: Tables) -> DataFrame:
    path = scratch(t, "training")
    w.write_training(items(t).where("is_corrected").select("text", F.col("new_label").alias("label")), path, "human")
    return r.read_labelled(t.spark, path)


@query("sink_02", f"with {ITEMS} select item_id, label, null::varchar decision from items where is_suspect")
def sink_02(t: Tables) -> DataFrame:
    path = scratch(t, "review")
    w.write_review_csv(items(t).where("is_suspect").select("item_id", "label"), path)
    return t.spark.read.option("header", True).schema("item_id string, label string, decision string").csv(path).withColumn("decision", F.when(F.col("decision") != "", F.col("decision")))


@query("sink_03")
def sink_03(t: Tables) -> DataFrame:
    f = visit_facts(t)
    rows = f.select(F.col("visit_id").alias("job_id"), "day", F.col("fact_id").alias("order_index"), F.col("code").alias("text"), F.col("code").alias("label"))
    fired = evaluate(f, _rules()).select(F.col("visit_id").alias("job_id"), "rule_id")
    path = scratch(t, "export")
    w.export_reports(rows, fired, path)
    return t.spark.read.text(path).select(F.get_json_object("value", "$.job_id").alias("job_id"), "day", F.length("value").alias("size"))


@query("stm_01", f"with {STATES} select effective_at::date as day, kind, count(*)::bigint n from states group by 1, 2")
def stm_01(t: Tables) -> DataFrame:
    """The table as a stream of files, shuffled by arrival; the finished stream has the batch's rows. A batch's counts replace those before."""
    path, out = scratch(t, "arrivals"), scratch(t, "days")
    states(t).withColumn("effective_at", F.col("effective_at").cast("timestamp")).select("effective_at", "kind", "event_id").repartition(4, F.hash("event_id")).write.parquet(path)
    stream = daily_counts(t.spark.readStream.schema("effective_at timestamp, kind string, event_id long").parquet(path))
    query = stream.writeStream.outputMode("complete").foreachBatch(lambda days, _: days.write.mode("overwrite").parquet(out)).option("checkpointLocation", scratch(t, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.schema("day date, kind string, n long").parquet(out)


@query("stm_02", f"""with {OBSERVED}, l as (select patient_id, unnest(arg_max({{'status': status, 'expires_at': expires_at}}, (effective_at, status))) from obs group by 1)
  select patient_id, status, coalesce(epoch_ms(expires_at) < (select epoch_ms(max(effective_at) - interval 40 day) from obs), false) expired from l""")
def stm_02(t: Tables) -> DataFrame:
    """State changes as a stream, appended to files; a patient's last change is the newest observation, and it has expired
    if its end lies before the watermark of the finished stream."""
    path, out = scratch(t, "observed"), scratch(t, "changes")
    rows = observed(t).select("patient_id", "status", F.col("effective_at").cast("timestamp").alias("effective_at"), F.col("expires_at").cast("timestamp").alias("expires_at"))
    rows.write.parquet(path)
    changes = state_changes(t.spark.readStream.schema(rows.schema).parquet(path), "40 days")
    query = changes.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch(t, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    told = t.spark.read.schema(OUTPUT).parquet(out)
    last = F.max_by("status", F.when(F.col("event") == "changed", F.struct("effective_at", "status")))
    return told.groupBy("patient_id").agg(last.alias("status"), F.bool_or(F.col("event") == "expired").alias("expired"))
