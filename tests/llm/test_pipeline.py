"""Stages against what they say they keep."""

import corpus_pipeline as p
from tests.oracle import FOLDER
from visitloom.llm import mixing, packing


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    before = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert sorted(after.columns) == sorted(docs.columns), name
        path = str(tmp_path / name)
        after.write.parquet(path)
        before = spark.read.parquet(path)
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= every and ids, name
        every = ids
    rows = p.STAGES[-1][1](spark, before, FOLDER)
    want = packing.pieces(before).agg({"length": "sum"}).first()[0]
    assert rows.agg({"length": "sum"}).first()[0] == want


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_hash long"
WORDS = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, None, "en", "a", 0, 5),
    (2, "", None, "a", 0, 5),
    (3, "one two three", "en", None, 13, 5),
    (3, "one two three", "en", None, 13, 5),
    (3, WORDS, "en", "a", 13, 5),
    (4, WORDS + " more", "en", "b", 13, 6),
    (None, WORDS, None, "b", 10, 5),
    (None, "quite another text of some words", None, "b", 10, 5),
    (None, "quite another text of some words", "fr", "b", 10, 5),
]


def test_one_document_of_each_group_stays(spark):
    """Documents that share an id aren't lost, rows without one are duplicates as any other, blank ones all stay."""
    docs = spark.createDataFrame(ROWS, SCHEMA).drop("row_hash")
    got = sorted(((r.doc_id, r.text) for r in p.distinct(spark, docs, FOLDER).collect()), key=str)
    assert got == sorted([(1, None), (2, ""), (3, "one two three"), (3, WORDS), (None, "quite another text of some words")], key=str)


def test_documents_stand_as_often_as_they_are_taken(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).drop("row_hash")
    taken = {}
    for r in mixing.mix(docs).collect():
        t = taken.setdefault((r.doc_id, r.source, r.row_hash), [0, 0, 0])
        t[0], t[1], t[2] = t[0] + r.taken, t[1] + r["size"], t[2] + 1
    want = sum(n * (1 if not size else int(got / size + 0.5)) for got, size, n in taken.values())
    assert p.mixed(spark, docs, FOLDER).count() == want


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    few = {"toxicity": len(ROWS), "language": 7, "near_duplicates": 5}
    for name, stage in p.STAGES:
        rows = stage(spark, docs, FOLDER)
        if name == "packing":
            assert rows.where("piece = 0").count() == len(ROWS)
        else:
            assert rows.columns == list(p.COLUMNS)
            n = rows.count()
            assert n <= 2 * len(ROWS) if name == "mixing" else n <= few[name]
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name


def test_runs_keep_their_own_tables(spark):
    """Results of two runs and of one stage called twice, read after all are made."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    stages = dict(p.STAGES)
    a, b = stages["packing"](spark, docs, FOLDER), stages["packing"](spark, docs, FOLDER)
    assert b.count() == a.count() > 0
    one, other = p.run(spark, FOLDER), p.run(spark, FOLDER)
    assert other.count() == one.count() > 0
