import random
import re

from pyspark.sql import functions as F

from visitloom.functions import text as tx
from visitloom.operators import mentions

CUES = {"a": ["no", "no doubt", "in case"], "b": ["doubt", "no way out"], "c": ["case", "c'est", "ﬁ no"], "d": ["été", "x"], "e": []}
PIECES = ["no", "doubt", "NO", "nodoubt", "in", "case", "way", "out", "c'est", "ﬁ", "été", "éte", "x́", "x", "1", " ", "  ", ", ", "-", "_", "​", "😀", "\n", "İ", "٬"]
NUMBERS = ["1", "٣", "۵", "٬", "٫", ".", ",", " ", "a", "12", "٬٬", "..", "k"]


def rows(spark, pieces, n=400):
    rng = random.Random(7)
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(n)]
    return spark.createDataFrame([(x,) for x in [*texts, None]], "c string")


def test_cues_are_those_of_padded_words(spark):
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower("c"), r"[^\p{L}\p{M}\p{N}]+", " "), F.lit(" "))
    for sep in ("", " "):
        df = rows(spark, [p + sep for p in PIECES])
        for r in df.select(low.alias("low"), tx.scope_sig(F.col("c"), CUES).alias("got")).collect():
            assert r.got == [k for k, words in CUES.items() if r.low is not None and any(f" {w} " in r.low for w in words)], r


def test_numbers_are_those_of_the_translated_text(spark):
    table = str.maketrans(tx.DIGITS_AND_MARKS[:-1], "01234567890123456789.", "٬")
    for r in rows(spark, NUMBERS).select("c", tx.numeric_sig(F.col("c")).alias("got")).collect():
        assert r.got == (None if r.c is None else [x.replace(",", ".") for x in re.findall(r"[0-9]+(?:[.,][0-9]+)?", r.c.translate(table))]), r


def test_guard_works_out_each_sign_once(spark):
    """Written out at every place that names them, the signs made a job go over each text dozens of times."""
    words = {"k": ["a", "b"]}
    reasons = mentions.guard(F.col("raw"), F.col("candidate"), ["mg"], words, words, words, {"f": ["she"], "m": ["he"]}, words)
    plan = spark.createDataFrame([("a", "b")], "raw string, candidate string").select(reasons.alias("reasons"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2
