"""Toxicity against a plain version: exact n-grams, backoff weights, shared and joined lookups."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from visitloom.llm import lookups
from visitloom.llm import toxicity as t


def grams(text):
    """Of each letter, the text that ends at it: at most 8 characters, from the blank before its word at the earliest."""
    low = "".join(c.lower()[0] if c.isalpha() else " " for c in " " + text)
    for i in range(1, len(low)):
        if low[i] != " ":
            yield low[max(low.rfind(" ", 0, i), i - 7) : i + 1]


def plain(rows):
    """A function from an n-gram to its log-ratio, learned from (text, class)."""
    n = {1: Counter(), 0: Counter()}
    for text, k in rows:
        n[k].update(grams(text))
    n["b"] = n[0] + n[1]
    kinds, tails = Counter(g[-4:] for g in n["b"]), defaultdict(Counter)
    for low, m in kinds.items():
        tails[low[:-1]][low] = m
    seen = {k: defaultdict(list) for k in n}
    for k, c in n.items():
        for g, m in c.items():
            seen[k][g[:-1]].append(m)

    def p(k, g, base):
        took = (0, *((0.8, 1.2, 1.5) if k == "b" else (0.95, 1.8, 2.5)))
        follow = seen[k].get(g[:-1])
        if not follow:
            return base
        return (n[k][g] - took[min(3, n[k][g])] + sum(took[min(3, m)] for m in follow) * base) / sum(follow)

    def ratio(g):
        if not n["b"][g]:
            base = 1e-3  # whatever is left for the letter, both classes back off to the same
            return math.log(p(1, g, base) / p(0, g, base)) if g[:-1] in seen["b"] else 0.0
        of = tails[g[-4:-1]]
        base = p("b", g, (kinds[g[-4:]] - 0.5 + 0.5 * len(of) / 40) / sum(of.values()))
        return math.log(max(1e-6, p(1, g, base)) / max(1e-6, p(0, g, base)))

    return ratio


TOXIC = ["vile vermin scum", "scummy vile vermin élan", "you vile scum"]
ORDINARY = ["vital verse and scenery", "you visit élite villas", "scenic and vital verse"]
LEARNED = [(x, 1) for x in TOXIC] + [(x, 0) for x in ORDINARY]
#: Most letters of these follow contexts that were seen, but not with these letters.
ASKED = ["vilq", "scumq verx viq", "you villains", "zzz", "", None, "Vile VERMIN"]


@pytest.mark.parametrize("shared", [1 << 23, 0])
def test_features_like_plain(spark, monkeypatch, shared):
    monkeypatch.setattr(t, "SHARED", shared)
    monkeypatch.setattr(lookups, "PACK", 8)
    counts = t.counted(spark.createDataFrame(LEARNED, "text string, cls int"))
    ratios = t.stored(t.keyed(t.log_ratios(counts)))
    rows = spark.createDataFrame(list(enumerate(ASKED)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in t.featured(rows, ratios).collect()}
    ratio = plain(LEARNED)
    assert len(got) == len(ASKED) and ratio(" vilq") != 0
    for i, text in enumerate(ASKED):
        want = t._worst(np.array([ratio(g) for g in grams(text or "")]))
        assert [got[i][c] for c in t.FEATURES] == pytest.approx(want, abs=1e-5)


def test_counts_sent_on_often_add_up(monkeypatch):
    import pyarrow as pa

    rows = [(f"some words {i} ähnlich {'zq' * (i % 7)} repeated repeated", i % 2) for i in range(400)]
    monkeypatch.setattr(t, "HELD", 10)
    batches = [pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows[i : i + 20]]), pa.array([k for _, k in rows[i : i + 20]])], ["text", "cls"]) for i in range(0, 400, 20)]
    sent = [b.to_pylist() for b in t._count(batches)]
    got = {1: Counter(), 0: Counter()}
    for batch in sent:
        for r in batch:
            got[1][r["gram"]] += r["toxic"]
            got[0][r["gram"]] += r["ordinary"]
    want = {1: Counter(), 0: Counter()}
    for text, k in rows:
        want[k].update(grams(text))
    assert len(sent) > 5 and {k: +c for k, c in got.items()} == want


def test_keys_that_begin_alike_keep_their_own_ratios():
    near = np.uint64(0xFFFFFF0000000000) + np.arange(50, dtype=np.uint64)
    keys = np.concatenate([near, np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)])
    values = np.arange(len(keys), dtype=np.float32) + 1
    found, missing = t.Ratios(keys, values).find(np.concatenate([keys, near + np.uint64(50), np.zeros(1, np.uint64)]))
    assert found[: len(keys)].tolist() == values.tolist() and not found[len(keys) :].any()
    assert sorted(missing.tolist()) == list(range(len(keys), len(keys) + 51))


def test_looked_up_ratios_are_small():
    keys = np.arange(1, 140_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ratios = t.Ratios(keys, np.ones(len(keys), np.float32))
    assert sum(x.nbytes for x in vars(ratios).values() if isinstance(x, np.ndarray)) <= 20 * len(keys)


def test_a_carried_text_goes_once(spark):
    docs = spark.createDataFrame([(i, x, "en") for i, (x, _) in enumerate(LEARNED)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, k) for i, (_, k) in enumerate(LEARNED)], "doc_id long, toxic int")
    out = t.score(docs, labels, carry=("doc_id", "text", "lang"))
    assert out._jdf.queryExecution().analyzed().toString().count("carry_text") == 0
    assert {(r.doc_id, r.text, r.lang) for r in out.collect()} == {(i, x, "en") for i, (x, _) in enumerate(LEARNED)}
