"""Readers with declared schemas: labelled lines, reports, transcripts, corpora, decisions, archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELLED = "text string, label string, source string"
ITEM = "item_id string, order_index int, text string, label string, confidence double"
REPORT = f"job_id string, patient_info map<string,string>, clinical_facts array<struct<code:string,value:string>>, soap map<string,struct<items:array<struct<{', '.join(x.replace(' ', ':', 1) for x in ITEM.split(', '))}>>>>"
TRANSCRIPT = "segments array<struct<text:string,start:double,end:double,avg_logprob:double>>"


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with text and label; a bad line fails the job, blank ones don't count."""
    return spark.read.schema(LABELLED).option("mode", "FAILFAST").json(path).where("text is not null")


def report_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a folder of files, one JSON document a file, a report or a list of reports. A row tells whether it is a
    report (readable), or a file that can't be read (unreadable), and holds the report's columns; JSON that is no report
    is neither."""
    rows = spark.read.schema(f"{REPORT}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    bad, named = F.col("_corrupt_record").isNotNull(), F.col("job_id").isNotNull()
    return rows.withColumns({"readable": ~bad & (named | F.col("soap").isNotNull()), "unreadable": bad & ~named}).drop("_corrupt_record")


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Reports, one JSON document a file (see report_rows), and how many files can't be read. Each of the two reads the files; who wants
    both counts takes them from report_rows at once."""
    rows = report_rows(spark, path)
    return rows.where("readable").drop("readable", "unreadable"), rows.agg(F.count_if("unreadable").alias("unreadable"))


def report_items(reports: DataFrame) -> DataFrame:
    """Items of reports, with ids and orders filled in where missing."""
    flat = reports.select("job_id", F.explode(F.map_entries("soap")).alias("e")).select("job_id", F.col("e.key").alias("section"), F.posexplode("e.value.items").alias("pos", "i"))
    order = F.coalesce("i.order_index", (F.row_number().over(Window.partitionBy("job_id").orderBy("section", "pos")) - 1).cast("int"))
    rows = flat.select("job_id", "section", order.alias("order_index"), "i.item_id", "i.text", "i.label", "i.confidence")
    made = F.concat_ws("-", "job_id", F.lpad(F.col("order_index").cast("string"), 4, "0"))
    return rows.withColumn("item_id", F.coalesce("item_id", made))


def structured_facts(reports: DataFrame) -> DataFrame:
    """Exact facts of reports: the list, and the numbers in the patient's map; with ids by place."""
    a = reports.select("job_id", F.posexplode("clinical_facts").alias("pos", "f")).select("job_id", F.lit("list").alias("origin"), "pos", "f.code", "f.value")
    b = reports.select("job_id", F.posexplode(F.array_sort(F.map_entries("patient_info"))).alias("pos", "f")).select("job_id", F.lit("map").alias("origin"), "pos", F.col("f.key").alias("code"), "f.value")
    return a.unionByName(b).withColumn("fact_id", F.concat_ws("-", "job_id", "origin", F.col("pos").cast("string"))).drop("pos")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("text string, decision string").option("multiLine", True).csv(path).where(F.trim("decision") != "")


def collect_corpus(*texts: DataFrame) -> DataFrame:
    """Texts of tables (text, at) trimmed, blank and repeated ones dropped; the first place of each stays."""
    every = None
    for k, df in enumerate(texts):
        one = df.select(F.trim("text").alias("text"), F.lit(k).alias("part"), F.col("at").cast("long").alias("at")).where("text <> ''")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("text").agg(F.min(F.struct("part", "at")).alias("p")).select("text", "p.part", "p.at")


def read_gold(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LABELLED).json(folder).na.drop(subset=["text", "label"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Files with their hash: path, length, sha256. Contents stay in the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_archive(files: DataFrame, catalog: DataFrame, limit: int) -> DataFrame:
    """ok, damaged or missing for catalogued objects (sha256, path, verified_at), least recently verified first."""
    found = files.select("path", F.col("sha256").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("damaged")
    return catalog.orderBy(F.col("verified_at").asc_nulls_first(), "path").limit(limit).join(found, "path", "left").select("path", "sha256", status.alias("status"))


def transcript_raw(transcripts: DataFrame) -> DataFrame:
    return transcripts.withColumn("raw", F.from_json("raw", TRANSCRIPT)).select("job_id", F.posexplode("raw.segments").alias("order_index", "s")).select("job_id", "order_index", "s.*")
