"""Level-wise counts against counts of everything."""

import random
import re
from collections import defaultdict

import pytest

from visitloom.operators import phrases


def plain(texts, stop, least, sizes=(2, 3, 4)):
    seen = defaultdict(list)
    for i, text in texts:
        own = re.findall(r"[^\W\d_]{2,}", (text or "").lower())
        for n in sizes:
            for k in range(len(own) - n + 1):
                seen[tuple(own[k : k + n])].append(i)
    good = {g: ids for g, ids in seen.items() if len(ids) >= least and not (g[0] in stop and g[-1] in stop) and not all(w in stop for w in g)}
    return {(" ".join(g), len(ids), min((i for i in ids if i is not None), default=None)) for g, ids in good.items()}


@pytest.mark.parametrize(("held", "sent"), [(1 << 21, 1 << 22), (5, 1 << 22), (1 << 21, 10)])
def test_frequent_phrases(spark, monkeypatch, held, sent):
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "SENT", sent)
    rng = random.Random(1)
    names = ["the", "of", "aa", "bb", "cc", "dd", "éé", "ff", "x", "m2n"]
    texts = [(i if i % 9 else None, " ".join(rng.choices(names, k=rng.randint(0, 30)))) for i in range(120)] + [(500, None), (501, ""), (502, "aa-bb, CC\nDD " * 20)]
    got = phrases.frequent_phrases(spark.createDataFrame(texts, "id long, text string"), ["the", "of"], 6).collect()
    assert {tuple(r) for r in got} == plain(texts, {"the", "of"}, 6) and len(got) > 20
    assert phrases.frequent_phrases(spark.createDataFrame([], "id long, text string"), ["the"], 1).count() == 0


def test_a_phrase_is_named_by_its_example_only():
    """Each key is sent on once in all, not once for each task, and looking keys up doesn't walk over all of them."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    key = phrases._grams(phrases._hashed(["aa", "bb"], {}), 2)
    sent = SimpleNamespace(value={2: (key, np.array([7], np.int64)), 3: (key[:0], np.zeros(0, np.int64))})
    parts = [pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(["aa bb cc aa bb"] * len(ids))], ["id", "text"]) for ids in ([9, 8], [7, None], [10])]
    assert [r for part in parts for b in phrases._namer(sent)([part]) for r in b.to_pylist()] == [{"size": 2, "key": int(key.view(np.int64)[0]), "phrase": "aa bb"}]


def test_counting_holds_little_at_a_time():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(2)
    texts = [" ".join(rng.choices(["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)], k=2000)) for _ in range(40)] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    list(phrases._counter(2, None)([batch.slice(0, 1)]))
    tracemalloc.start()
    rows = sum(b.num_rows for b in phrases._counter(2, None)([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 50_000 and most < 160 << 20


@pytest.mark.parametrize("chars", [1 << 18, 3])
def test_words_are_told_apart_in_any_script(monkeypatch, chars):
    monkeypatch.setattr(phrases, "CHARS", chars)
    texts = ["ab ba ab\nx a\u0301b\u0301", "", "\u0130stanbul \u03a3\u03a3 \u039f\u0394\u039f\u03a3 caf\u00e9 CAF\u00c9", "\u4f60\u597d\u4e16\u754c \U00020000\U00020001x \U0001f600", "l" * 50 + "m2n" + "no-no no_no", "\u216b\u216b \u00b2\u00b2 \u0e01\u0e02"]
    own = [(w, i) for i, x in enumerate(texts) for w in phrases.words(x)]
    h, of = phrases._split([x.lower() for x in texts])
    assert of.tolist() == [i for _, i in own]
    assert len(set(h.tolist())) == len({w for w, _ in own}) == len(set(zip(h.tolist(), [w for w, _ in own], strict=True)))
    assert phrases._hashed([w for w, _ in own], {}).tolist() == h.tolist()


@pytest.mark.parametrize("bits", [1 << 27, 1 << 9])
def test_only_what_can_be_of_the_top_is_named(spark, monkeypatch, bits):
    named, was = [], phrases._named
    monkeypatch.setattr(phrases, "_named", lambda rows, found, sizes: named.append(found.count()) or was(rows, found, sizes))
    rng = random.Random(3)
    monkeypatch.setattr(phrases, "BITS", bits)
    names = ["the", "of", "aa", "bb", "cc", "dd", "ee", "ff"]
    texts = [(i if i % 9 else None, " ".join(rng.choices(names, k=rng.randint(0, 30)))) for i in range(150)]
    known = ["AA bb", "cc", "dd  ee", "ee, ff", "ff the aa", None, "", "the of aa bb cc"]
    every = plain(texts, {"the", "of"}, 4)
    inner = lambda p: {" ".join(p.split()[i : i + n]) for n in range(1, 5) for i in range(len(p.split()) - n + 1)}
    good = [x for x in every if not inner(x[0]) & {(k or "").lower() for k in known}]
    held = {f for x in good for f in inner(x[0]) - {x[0]}}
    want = sorted((x for x in good if x[0] not in held), key=lambda x: (-x[1], x[0]))
    got = phrases.mine_phrases(spark.createDataFrame(texts, "id long, text string"), ["the", "of"], 4, 10, spark.createDataFrame([(k,) for k in known], "phrase string"))
    assert [tuple(r) for r in got.collect()] == want[:10] and len(want) > 20
    assert named == [sum(x[1] >= want[9][1] for x in want)]
