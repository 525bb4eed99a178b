"""Patterns, automata and what they add."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from visitloom.llm import secrets_scan
from visitloom.llm.queries import queries

BASE = {
    "assign": r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m.group(2 if kind == "assign" else 0)) >= LEAST[kind]]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def scanned(spark, rows, schema="doc_id long, text string"):
    return secrets_scan.digest(secrets_scan.scan(spark.createDataFrame(rows, schema))).collect()


def key(rng, n=20):
    return "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=n - 4))


def corpus(rng):
    words = ["thenonhe", "ererthontion", "verschiebung", "nenleaux", "Bodoraciona", "mail3.example.com", "2024-11-05", "ingthention,", "an", "of"]
    docs = []
    for i in range(300):
        text = " ".join(rng.choice(words) + "".join(rng.choices("aeinrst", k=rng.randint(0, 5))) for _ in range(40))
        extra = [f"password={rng.getrandbits(72):018x}", key(rng), f'token = "{rng.getrandbits(160):040x}"', ""][i % 4]
        docs.append((i, f"{text} {extra} {text[::-1]}"))
    return docs


def test_base_spans(spark):
    docs = [
        (1, "PassWord: 'abcdefgh' passwd=short token=token=abcdefgh12 ſecret=abcdefgh apIKey = \"A+/_.=-9x\""), (2, "xAKIAABCDEFGHIJKL AKIA AKIAAKIAABCDEFGHIJ akiaABCDEFGHIJKLMN"),
        (3, "e" * 32 + "g" + "0" * 31 + "G" + "ab" * 5000), (4, 'secret: "token": "abcdefghijk"'), (5, None), (5, ""), (None, "\U0001f600é api_key:" + "q" * 8), (6, "token = " + "ab12" * 50_000), (7, "x " * 300_000 + "passwd='12345678'"),
    ]
    got = scanned(spark, docs)
    assert len(got) == len(docs)
    by = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got)
    want = Counter()
    for i, t in docs:
        s = plain(t)
        want[i, *(sum(x.startswith(k) for x in s) for k in BASE), hashlib.sha256(",".join(s).encode()).hexdigest()] += 1
    assert by == want
    assert all(r["spans"] == ",".join(plain(dict(docs[:5] + docs[6:])[r["doc_id"]])) for r in got if r["doc_id"] in (1, 2, 3, 4, 6, 7))


def test_automata_add_what_looks_like_credentials(spark):
    rng = random.Random(2)
    docs = corpus(rng)
    bare, short = f"{rng.getrandbits(80):020x}", f"{rng.getrandbits(112):028x}"
    planted = [(1000, f"here {bare} stands"), (1001, f"and {short}, too"), (1002, "only ererthontionas and verschiebungen here, as 2024-11-05")]
    got = {r["doc_id"]: r for r in scanned(spark, docs + planted)}
    assert got[1000]["spans"] == "format:5:25" and got[1001]["spans"] == f"format:4:{4 + 28}"
    assert got[1000]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [i for i, t in docs if "format" in got[i]["spans"]] == []
    for i, t in docs:
        assert [s for s in got[i]["spans"].split(",") if s] == plain(t)


def test_counts_sent_on_often_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(random.Random(3)), "doc_id long, text string")
    known = docs.sparkSession.createDataFrame(secrets_scan.values(docs).collect(), "label string, value string")
    want, letters = secrets_scan.learn(known)
    monkeypatch.setattr(secrets_scan, "HELD", 7)
    got, same = secrets_scan.learn(known)
    assert (letters == same).all() and letters.sum() == sum(len(r["value"]) for r in known.where("label = 'ordinary'").collect())
    assert sorted(got) == sorted(want) == ["access", "assign", "hex", "ordinary"]
    for label in want:
        assert (got[label].goes == want[label].goes).all() and (got[label].counts == want[label].counts).all()


def test_merged_states_loop():
    rng = random.Random(4)
    tree = {}
    for _ in range(4000):
        value = "".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10])))
        for i in range(len(value) + 1):
            row = tree.setdefault(value[:i], np.zeros(secrets_scan.END + 1))
            row[secrets_scan.SYMBOLS.index(value[i]) if i < len(value) else secrets_scan.END] += 1
    whole = sum(len(v.nonzero()[0]) > 0 for v in tree.values())
    made = secrets_scan.inferred({p: v for p, v in tree.items() if v.sum() >= secrets_scan.EVIDENCE})
    assert len(made.goes) < whole / 20
    fixed = {"K" * i: v for i, v in enumerate(np.eye(secrets_scan.END + 1)[[secrets_scan.SYMBOLS.index("K")] * 3 + [secrets_scan.END]] * 500)}
    assert len(secrets_scan.inferred(fixed).goes) == 4  # exactly three: nothing to merge


def test_likelihood_symbol_by_symbol():
    goes = np.full((2, len(secrets_scan.SYMBOLS)), -1)
    a, b = secrets_scan.SYMBOLS.index("a"), secrets_scan.SYMBOLS.index("b")
    goes[0, a], goes[1, b] = 1, 0
    counts = np.zeros((2, secrets_scan.END + 1))
    counts[0, a], counts[1, b], counts[1, secrets_scan.END] = 9, 4, 5
    made = secrets_scan.Automaton(goes, counts)
    costs = made.costs()
    texts = ["ab", "a", "ba", "ab" * 400 + "a", "zz" + "ab" * 600]
    got = secrets_scan.likelihoods(made, texts)
    for text, nats in zip(texts, got, strict=True):
        state, want = 0, 0.0
        for c in text:
            s = secrets_scan.SYMBOLS.index(c)
            want += costs[state, s]
            state = 2 if state == 2 or goes[state, s] < 0 else goes[state, s]
        assert abs(nats - want - costs[state, secrets_scan.END]) < 1e-6


def test_odd_rows(spark):
    assert scanned(spark, []) == []
    wide = scanned(spark, [(1, "token=abcdefgh", "x", "y", 3)], "doc_id long, text string, label string, found string, value int")
    assert [tuple(r)[:4] for r in wide] == [(1, 1, 0, 0)]


def test_query_keeps_base(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries()["op13_secret_scan"](spark, "/root/testdata/sf0.001").collect():
        base = plain(docs[r["doc_id"]])
        assert [s for s in r["spans"].split(",") if s and not s.startswith("format")] == base
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
