"""Language models against a plain version, shared and joined; rejection of junk at two sizes."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.llm import charlm, language, lookups

TEXTS = [("la casa è rossa", 0), ("la cosa casa", 0), ("дом стоит дома", 1), ("the house 12", 2), ("中文 字", 2)]
ASKED = ["la casa", "дома домик", "zzz the", "中字", "𐐀𐐁 la", "12", "", None]


def symbols(text):
    return [c.lower()[0] if c.isalpha() else " " for c in text]


def plain(rows):
    """log p of a four-gram by class, by the textbook."""
    classes = sorted({k for _, k in rows})
    n = {c: Counter() for c in classes}
    for text, c in rows:
        s = [" "] * 3 + symbols(text)
        n[c].update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    levels = {c: {4: n[c]} for c in classes}
    for c in classes:
        for k in (3, 2, 1):
            levels[c][k] = Counter(g[1:] for g in levels[c][k + 1])

    def p(c, g):
        k = len(g)
        if not k:
            return 1 / (len(levels[c][1]) + 1)
        table = levels[c][k]
        once, twice = (sum(v == x for v in table.values()) for x in (1, 2))
        off = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        follow = [v for h, v in table.items() if h[:-1] == g[:-1]]
        if not follow:
            return p(c, g[1:])
        return max(0, table[g] - off) / sum(follow) * (table[g] > 0) + off * len(follow) / sum(follow) * p(c, g[1:])

    return lambda g: [math.log(p(c, g)) for c in classes]


@pytest.mark.parametrize("shared", [1 << 25, 0])
def test_cross_entropies_like_plain(spark, monkeypatch, shared):
    monkeypatch.setattr(language, "SHARED", shared)
    monkeypatch.setattr(lookups, "PACK", 8)
    model = language.stored(charlm.fitted(charlm.counted(spark.createDataFrame(TEXTS, "text string, cls int"))))
    rows = spark.createDataFrame(list(enumerate(ASKED)), "n int, text string").repartition(2)
    got = {r.n: r for r in language.Identifier(model, ["a", "b", "c"]).score(rows).collect()}
    log_p = plain(TEXTS)
    assert len(got) == len(ASKED)
    for i, text in enumerate(ASKED):
        s = [" "] * 3 + symbols(text or "")
        letters = sum(c != " " for c in s)
        assert got[i].n_letters == letters
        if not letters:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        mean = np.mean([log_p(tuple(s[j - 3 : j + 1])) for j in range(3, len(s))], axis=0)
        assert got[i].lang_pred == "abc"[int(np.argmax(mean))] and got[i].cross_entropy == pytest.approx(-mean.max(), abs=1e-4)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_junk_is_rejected_and_clean_texts_are_kept(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text", "lang")
    drawn = random.Random(3)
    noise = lambda n: " ".join("".join(drawn.choices("abcdefghijklmnopqrstuvwxyz", k=drawn.randint(3, 9))) for _ in range(n))
    junk = [(10**9 + i, noise(n), None) for i, n in enumerate([8, 15, 40, 100, 400] * 3)]
    # One labelled text of noise must not move what its language rejects.
    junk += [(10**8 + i, noise(17), "en") for i in range(2)]
    got = language.identify(docs.unionByName(spark.createDataFrame(junk, docs.schema))).select("doc_id", "rejected").collect()
    assert all(r.rejected for r in got if r.doc_id >= 10**9)
    assert np.mean([r.rejected for r in got if r.doc_id < 10**8]) <= 0.001


def test_held_out_rows_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = language.identify(docs, carry=("lang",)).where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert both >= 0.98


def test_very_long_text(spark):
    rows = [(1, "la casa rossa " * 200_000, "it"), (2, "the red house", "en"), (3, "la casa", None), (4, "red the", "en"), (6, "casa la", "it")]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] == got[3] == "it"
