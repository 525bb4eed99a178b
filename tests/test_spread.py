from pyspark.sql import functions as F

from tests.oracle import FOLDER, differences
from visitloom import catalog
from visitloom.operators import updates
from visitloom.plans import bindings
from visitloom.plans.registry import Tables


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    """The session's four partitions held all rows, however many, so that a task's sort grew with the input."""
    t = Tables(spark, FOLDER)
    n = t.lineitem.count()
    assert bindings.tasks_for(t.lineitem) == 4
    monkeypatch.setattr(bindings, "ROWS_A_TASK", 500)
    assert bindings.tasks_for(t.lineitem) == -(-n // 500)
    query, sql = catalog.queries()["upd_05_log"], catalog.oracle_sql()["upd_05_log"]
    df = query(spark, FOLDER)
    per_task = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(per_task) > 8 and max(per_task) < 1000
    assert differences(spark, "upd_05_log", query, sql) == ""


def test_log_spread_over_many_tasks(spark):
    items = spark.createDataFrame([("i", "a", "s"), ("j", None, "t")], "item_id string, label string, speaker string")
    edits = spark.createDataFrame(
        [("i", "label", "b", 1), ("i", "label", "b", 2), ("i", "speaker", "s", 1), ("j", "label", None, 1), ("j", "text", "x", 1), ("j", "shape", "x", 1), ("k", "label", "x", 1)],
        "item_id string, field string, value string, at long",
    )
    want = {("i", "label", "a", "b", 1, "applied"), ("i", "label", "b", "b", 2, "no_change"), ("i", "speaker", "s", "s", 1, "no_change"), ("j", "label", None, None, 1, "no_change"), ("j", "text", None, "x", 1, "applied"), ("j", "shape", None, "x", 1, "unknown_field"), ("k", "label", None, "x", 1, "unknown_item")}
    for tasks in (None, 9):
        assert {tuple(r) for r in updates.correction_log(items, edits, tasks=tasks).collect()} == want
