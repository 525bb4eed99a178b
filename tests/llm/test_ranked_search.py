"""Treaps against scores of every document, one by one."""

import math
import random
import re
from collections import Counter

import numpy as np

from tests.oracle import differences
from visitloom.llm import ranked_search
from visitloom.llm.queries import oracle_sql, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    read = [(i, TERM.findall((t or "").translate(FOLD))) for i, t in docs]
    read = [(i, w) for i, w in read if w]
    n_docs, n_terms = len(read), sum(len(w) for _, w in read)
    df = Counter(t for _, w in read for t in set(w))
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(FOLD)))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, words in read:
            tf, m = Counter(words), 100 - 90 + (90 * len(words) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10):
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    return sorted(map(tuple, got.collect()), key=repr)


def rows(rng, n, most):
    names = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i * 3 % 1000, " ".join(rng.choices(names, weights, k=rng.randint(0, most)))) for i in range(n)]


def test_many_grids_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "DOCS", 16)
    monkeypatch.setattr(ranked_search, "WIDE", 3)
    monkeypatch.setattr(ranked_search, "ROUND", 60)
    rng = random.Random(5)
    docs, items = rows(rng, 300, 60), [(i, t) for i, (_, t) in enumerate(rows(rng, 12, 20))]
    assert found(spark, docs, items) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(1, "Été ÀB, été"), (1, "Été ÀB, été"), (None, "été"), (2, None), (3, ""), (4, "... \x00 \x7f"), (5, "\U0001f600\U0001f600 x"), (6, "long " * 200_000 + "rare"), (7, "ÉTÉ"), (-8, "x X x")]
    docs += [(100 + i, "same words here") for i in range(40)]
    items = [(1, "été àb"), (2, None), (3, "nothing known"), (None, "x"), (4, "x x X \U0001f600\U0001f600"), (5, "rare long"), (6, "same here"), (6, "words"), (7, "")]
    want = plain(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, 3) == plain(docs, items, 3)
    d = spark.createDataFrame([(*r, 1, 2, "k") for r in docs], "doc_id long, text string, n int, score int, terms string")
    i = spark.createDataFrame([(*r, 1, 2, "k") for r in items], "item_id long, text string, rank int, doc_id int, terms string")
    assert sorted(map(tuple, ranked_search.search(d, i).collect()), key=repr) == want


def test_no_rows(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []


def test_treap_opens_few_ranges():
    rng = np.random.default_rng(1)
    rows, docs = rng.integers(0, 200, 20_000), rng.integers(0, 4096, 20_000)
    at = np.unique(rows * 4096 + docs)
    values = (rng.pareto(1.5, len(at)) * 1000).astype(np.int64) + 1
    treap = ranked_search.Treap(at // 4096, at % 4096, values, 200, 4096)
    dense = np.zeros((200, 4096), np.int64)
    dense[at // 4096, at % 4096] = values
    asked = np.array([3, 50, 120])
    opened = []
    counted = type("Counted", (np.ndarray,), {"__getitem__": lambda self, k: (opened.append(np.size(k)), np.asarray(self)[k])[1]})
    treap.value = treap.value.view(counted)
    columns, scores = treap.best(asked, 0, 10)
    whole = dense[asked].sum(axis=0)
    best = np.sort(whole)[-10:]
    assert sorted(scores.tolist())[-10:] == best.tolist()
    assert (whole[columns] == scores).all() and set(np.flatnonzero(whole >= best[0])) == set(columns.tolist())
    assert sum(opened) < 3 * 2 * 4096 / 4


def test_same_as_sql(spark):
    assert differences(spark, "op12_ranked_search", queries()["op12_ranked_search"], oracle_sql()["op12_ranked_search"]) == ""
