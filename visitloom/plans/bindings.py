"""How the driver's tables play the parts of visits, items, states and facts; in DataFrames and, for the same, in SQL."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.operators.updates import spread
from visitloom.plans.registry import Tables

#: Rows that a task sorts at a time, about; Spark's own number of shuffle partitions doesn't grow with the input.
ROWS_A_TASK = 500_000


def tasks_for(table: DataFrame) -> int:
    """How many partitions to shuffle a table of files into (its rows are counted from their footers): the session's
    number, more if a partition would get more than ROWS_A_TASK."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(table.count() / ROWS_A_TASK))


LINE = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def jobs(t: Tables) -> DataFrame:
    """Jobs of patients: orders."""
    status = F.create_map(*[F.lit(x) for x in ("P", "queued", "O", "running", "F", "complete")])
    return t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("patient_id"), status[F.col("o_orderstatus")].alias("status"), F.col("o_orderdate").alias("visit_at"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("severity"))


JOBS = """jobs as (select o_orderkey job_id, o_custkey patient_id, case o_orderstatus when 'P' then 'queued' when 'O' then 'running'
  when 'F' then 'complete' end status, o_orderdate visit_at, o_totalprice price, o_orderpriority severity from orders)"""


def items(t: Tables) -> DataFrame:
    """Report items: lineitem, numbered per order over all columns, as line numbers repeat."""
    order = Window.partitionBy("l_orderkey").orderBy(*LINE)
    rows = spread(t.lineitem, tasks_for(t.lineitem), "l_orderkey").withColumn("order_index", (F.row_number().over(order) - 1).cast("int"))
    return rows.select(
        F.col("l_orderkey").alias("job_id"),
        "order_index",
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.lpad(F.col("order_index").cast("string"), 4, "0")).alias("item_id"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"),
        F.col("l_returnflag").alias("label"),
        F.col("l_linestatus").alias("new_label"),
        F.round((F.col("l_discount") + 0.0) * 10, 4).alias("confidence"),
        F.round((F.col("l_tax") + 0.0) * 10, 4).alias("ood"),
        F.round(F.col("l_quantity") / 50, 4).alias("entropy"),
        (F.col("l_quantity") > 40).alias("is_corrected"),
        (F.col("l_quantity") < 4).alias("is_suspect"),
        F.col("l_partkey").alias("code"),
        F.col("l_shipdate").alias("corrected_at"),
    )


ITEMS = """items as (select l_orderkey job_id, order_index, l_orderkey || '-' || lpad(order_index::varchar, 4, '0') item_id,
  'part ' || l_partkey as text, l_returnflag as label, l_linestatus new_label, round((l_discount + 0.0) * 10, 4) confidence,
  round((l_tax + 0.0) * 10, 4) ood, round(l_quantity / 50, 4) entropy, l_quantity > 40 is_corrected, l_quantity < 4 is_suspect,
  l_partkey code, l_shipdate corrected_at
  from (select *, (row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1)::int order_index from lineitem))"""

DAY = 86400


def states(t: Tables) -> DataFrame:
    """State observations of patients: events; pregnant is null where nothing is said."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    pregnant = F.when(kind == "signup", True).when(kind.isin("purchase", "error"), False)
    return t.events.select("event_id", F.col("user_id").alias("patient_id"), F.col("ts").alias("effective_at"), kind.alias("kind"), pregnant.alias("pregnant"), (kind == "purchase").alias("postpartum"), F.when(kind == "signup", k % 41).alias("ga_weeks"), "value", k.alias("k"))


STATES = """states as (select event_id, user_id patient_id, ts effective_at, event_type kind,
  case when event_type = 'signup' then true when event_type in ('purchase', 'error') then false end pregnant,
  event_type = 'purchase' postpartum, case when event_type = 'signup' then json_extract_string(props, '$.k')::int % 41 end ga_weeks,
  value, json_extract_string(props, '$.k')::int k from events)"""


def facts(t: Tables) -> DataFrame:
    """Facts of visits: an event a fact, its type the code; a visit is a patient's day."""
    return t.events.select("event_id", F.col("user_id").alias("patient_id"), F.to_date("ts").alias("day"), F.col("event_type").alias("code"), F.col("value").alias("value"), F.col("ts").alias("seen_at"), (F.col("value") < 1).alias("negated"))


FACTS = """facts as (select event_id, user_id patient_id, ts::date as day, event_type code, value as value, ts seen_at, value < 1 negated from events)"""


def segments(t: Tables) -> DataFrame:
    """Transcript segments: turns of conversations."""
    return t.conversations.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("order_index"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))


SEGMENTS = "segments as (select conv_id job_id, turn order_index, role speaker, coalesce(text, '') as text from conversations)"
