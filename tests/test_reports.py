import json

from pyspark.sql import functions as F

from visitloom.sources import readers, writers


def test_many_reports_make_few_files(spark, tmp_path):
    items = F.array(F.struct(F.lit("i").alias("item_id"), F.lit(0).alias("order_index"), F.lit('a "b"\nc').alias("text"), F.lit("x").alias("label"), F.lit(0.5).alias("confidence")))
    made = spark.range(1000).select(
        F.col("id").cast("string").alias("job_id"),
        F.create_map(F.lit("age_years"), F.lit("3")).alias("patient_info"),
        F.array(F.struct(F.lit("turns").alias("code"), F.col("id").cast("string").alias("value"))).alias("clinical_facts"),
        F.create_map(F.lit("s"), F.struct(items.alias("items"))).alias("soap"),
    )
    path = tmp_path / "reports"
    writers.write_reports(made, str(path))
    assert len(list(path.glob("part-*"))) <= 4
    reports, bad = readers.read_reports(spark, str(path))
    assert sorted(map(repr, reports.collect())) == sorted(map(repr, made.collect())) and bad.first().unreadable == 0
    assert readers.report_rows(spark, str(path)).where("readable").count() == 1000


def test_files_of_one_report_of_many_and_of_none(spark, tmp_path):
    one = {"job_id": "a", "soap": {"s": {"items": [{"item_id": "i", "text": "t"}]}}}
    (tmp_path / "one.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "many.json").write_text(json.dumps([one | {"job_id": "b"}, one | {"job_id": "c"}]))
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "other.json").write_text('{"b": 1}')
    (tmp_path / "cut.json").write_text(json.dumps(one)[:-4])
    (tmp_path / "text.json").write_text("no JSON\nat all")
    reports, bad = readers.read_reports(spark, str(tmp_path))
    assert sorted(r.job_id for r in reports.collect()) == ["a", "b", "c"]
    unreadable = bad.first().unreadable
    both = readers.report_rows(spark, str(tmp_path)).agg(F.count_if("readable").alias("good"), F.count_if("unreadable").alias("bad")).first()
    assert (both.good, both.bad) == (3, unreadable) and unreadable == 2
