"""The automaton against texts searched term by term."""

import random
import re
import time

import pytest

from visitloom.operators import lexicon as lx

WORD = re.compile(r"[^\W_]+")


def plain(text, terms, prefixes=("",)):
    words = WORD.findall(text.lower())
    out = set()
    for kind, code, surface in terms:
        own = WORD.findall(surface.lower())
        for i in range(len(words) - len(own) + 1):
            if any(words[i] == p + own[0] for p in prefixes) and words[i + 1 : i + len(own)] == own[1:]:
                out.add((kind, code, surface.lower(), i, len(own)))
    return out


def plain_claims(hits):
    """Longest surface first, its first place that is free; a code once."""
    out = []
    for h in sorted(hits, key=lambda h: (-len(h[2]), h[2], h[1], h[3])):
        if not any(o[0] == h[0] and (o[1] == h[1] or (o[3] < h[3] + h[4] and h[3] < o[3] + o[4])) for o in out):
            out.append(h)
    return set(out)


def cases(rng):
    letters = ["al", "ba", "co", "du", "über", "x1", "walco"]
    terms = [(rng.choice(["s", "t"]), f"c{rng.randrange(12)}", " ".join(rng.choices(letters, k=rng.randint(1, 3))).upper()) for _ in range(25)]
    texts = [(i, "".join(rng.choice(letters) + rng.choice([" ", ", ", "_", ""]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    return terms, texts + [(90, ""), (91, "İal BA"), (92, "wal ba")]


@pytest.mark.parametrize("sent", [1 << 19, 7])
@pytest.mark.parametrize("prefixes", [("",), ("", "w", "wal")])
def test_terms_and_claims(spark, monkeypatch, sent, prefixes):
    monkeypatch.setattr(lx, "SENT", sent)
    terms, texts = cases(random.Random(1))
    t, lex = spark.createDataFrame([*texts, (93, None)], "id long, text string"), spark.createDataFrame([*terms, (None, "c", "al"), ("s", "c", None)], "kind string, code string, surface string")
    want = {(i, *h) for i, text in texts for h in plain(text if i != 91 else "ial BA", terms, prefixes)}
    got = lx.find_terms(t, lex, prefixes).collect()
    assert {tuple(r)[:6] for r in got if r["id"] != 91} == {w for w in want if w[0] != 91} and len({tuple(r) for r in got}) == len(got)
    by = dict(texts)
    for r in got:
        if r["n_words"] == 1:
            assert lx.small(by[r["id"]])[r["begin"] : r["end"]] == r["surface"]
    kept = {tuple(r)[:6] for r in lx.mentions(t, lex, prefixes).collect()}
    assert kept == {(i, *h) for i in by for h in plain_claims({tuple(r)[1:6] for r in got if r["id"] == i})}


def test_exact_spacing(spark):
    t = spark.createDataFrame([(1, "of, the of  the OF THE of-the")], "id long, text string")
    lex = spark.createDataFrame([("s", "a", "of the"), ("s", "b", "of-the")], "kind string, code string, surface string")
    assert sorted((r["code"], r["begin"], r["end"]) for r in lx.find_terms(t, lex, exact=True).collect()) == [("a", 16, 22), ("b", 23, 29)]


def test_100_000_phrases(spark):
    rng = random.Random(2)
    names = [f"{a}{b}" for a in "abcdefghij" for b in range(100)]
    terms = {" ".join(rng.choices(names, k=rng.randint(2, 4))): i for i in range(100_000)}
    texts = [(i, " ".join(rng.choices(names, k=200)) + " " + rng.choice(list(terms)[:500]) + " tail") for i in range(300)]
    lex = spark.createDataFrame([("s", str(c), p) for p, c in terms.items()], "kind string, code string, surface string")
    began = time.time()
    got = {tuple(r)[:6] for r in lx.find_terms(spark.createDataFrame(texts, "id long, text string"), lex).collect()}
    assert time.time() - began < 60
    want = set()
    for i, text in texts:
        words = text.split()
        for n in (2, 3, 4):
            for k in range(len(words) - n + 1):
                phrase = " ".join(words[k : k + n])
                if phrase in terms:
                    want.add((i, "s", str(terms[phrase]), phrase, k, n))
    assert got == want and len(got) >= 300


@pytest.mark.parametrize("sent", [1 << 19, 2])
def test_triggers(spark, monkeypatch, sent):
    monkeypatch.setattr(lx, "SENT", sent)
    t = spark.createDataFrame([(1, "abcabd"), (2, None), (3, ""), (4, "Abd")], "id long, text string")
    phrases = spark.createDataFrame([("x", "bca"), ("y", "bd"), ("y", "ab"), ("z", "abd"), ("n", ""), (None, "a"), ("o", "d")], "code string, phrase string")
    assert sorted(map(tuple, lx.triggers(t, phrases).collect())) == [(1, "o"), (1, "x"), (1, "y"), (1, "z"), (4, "o"), (4, "y")]
    assert lx.triggers(t, phrases.limit(0)).count() == 0
