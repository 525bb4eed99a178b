"""A training corpus out of raw documents: each stage works on all that the one before it kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm import language, mixing, near_duplicates, packing, toxicity
from visitloom.llm.common import noted, removed, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict to be toxic.

    Rows count one by one, repeated ones too; a null id or text is scored as any other, an empty text by its lack of
    evidence. Columns besides COLUMNS are dropped. No rows: none.
    """
    labels = spark.read.parquet(table(sf_dir, "labels"))
    return toxicity.score(docs, labels, carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the language models recognise a language.

    Null and empty texts and those without a letter go; repeated rows and rows without an id are judged one by one, ties
    between languages don't matter. Columns besides COLUMNS are dropped. No rows: none.
    """
    return language.identify(docs, carry=COLUMNS).where("not rejected").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, of several the one with the smallest hash.

    Rows are told apart by all their columns, so rows that share an id but not a text are documents of their own, and a
    row without an id is kept only where its group has no other. Of rows that are equal in all columns one stays.
    Documents without words are duplicates of nothing and all stay. Other columns are dropped. No rows: none.
    """
    rows = docs.select(*COLUMNS).withColumn("row_hash", F.xxhash64(*COLUMNS))
    found = near_duplicates.near_duplicates(rows, carry=("row_hash",)).where("group_id is not null")
    first = found.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_hash")).alias("f"))
    chosen = first.select(F.col("f.doc_id").alias("id"), F.col("f.row_hash").alias("hash"))
    kept = rows.join(chosen, (F.col("row_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["row_hash", "doc_id"])
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.select(*COLUMNS).unionByName(rows.where(blank).select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole number; those without words stay once.

    Rows that are equal in id, text and source are taken equally often. A null source is a source; rows without an id are
    told apart by their texts. Columns besides COLUMNS are dropped. No rows: none.
    """
    rows = docs.select(*COLUMNS)
    took = mixing.mix(rows).groupBy("doc_id", "source", "row_hash").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    counted = took.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), "row_hash", times.alias("times")).where("times > 0")
    same = (F.xxhash64(rows["doc_id"], rows["text"]) == counted["row_hash"]) & F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of"))
    return rows.join(counted, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; null and empty texts are one closing token each."""
    return packing.pack(docs)


_PLAIN = [("toxicity", not_toxic), ("language", known_language), ("near_duplicates", distinct), ("mixing", mixed), ("packing", packed)]
#: What the last call of each stage over each folder left on its way.
_left: dict[tuple[int, str], list[str]] = {}


def _alone(nth: int, stage):
    """The stage, once what the last call of the stage before stored on its way is deleted: its result has been written.
    What a stage itself or any later one left stays, so results that aren't read yet keep theirs."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        removed(spark, _left.pop((nth - 1, sf_dir), []))
        own: list[str] = []
        with noted(own):
            out = stage(spark, docs, sf_dir)
        _left[nth, sf_dir] = own
        return out

    return run


#: Called one by one, each stage's result must be written before the next one of the same folder is called.
STAGES = [(name, _alone(k, stage)) for k, (name, stage) in enumerate(_PLAIN)]
#: SQL can't express what the models of the first stages learn; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A run deletes only what it stored itself; runs at the same time don't meet."""
    docs = spark.read.parquet(table(sf_dir, "documents"))
    before: list[str] = []
    for _, stage in _PLAIN[:-1]:
        now: list[str] = []
        with noted(now):
            docs = stored(stage(spark, docs, sf_dir))
        removed(spark, before)
        before = now
    return _PLAIN[-1][1](spark, docs, sf_dir)
