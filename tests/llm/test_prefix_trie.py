"""The trie against plain walks over every prefix."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tests.oracle import differences
from visitloom.llm import prefix_trie
from visitloom.llm.queries import oracle_sql, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """By conversation, prefix by prefix."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        yield p
        for k in kids[p]:
            yield from below(k)

    out = []
    for p, m in members.items():
        under = list(below(p))
        ids = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in under), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, schema=SCHEMA):
    return sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, schema)).collect()), key=repr)


def test_branches_at_every_depth(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 8)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    rng = random.Random(3)
    rows = []
    for c in range(0, 60):
        n, cut = rng.randint(0, 21), rng.randint(0, 21)
        for t in range(n):
            rows.append((c * 37 % 500, t, "user" if t % 2 else None, f"t{t}" if t < cut else rng.choice(["x", "yy", None])))
    assert found(spark, rows) == plain(rows)


def test_lines_hang_below_lines(spark):
    # Each conversation follows the one before one turn further, so lines hang eleven deep.
    rows = [(c, t, "r", f"{min(t, c)}-{t}") for c in range(12) for t in range(14)]
    rows += [(c + 600, t, "r", "same") for c in range(1, 40) for t in range(9)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "r", "lost"), (5, None, None, None), (5, 2, "b", "x"), (5, 2, "a", "y"), (5, 2, "a", "x"), (5, 2, "a", "x"), (5, None, "z", ""),
        (-7, 0, "r", "\U0001f600é"), (-7, 1, "r", "w" * 300_000), (107, 0, "r", "gone"), (207, 0, "ab", "c"), (208, 0, "a", "bc"), (200, 0, "q", "first"),
    ]
    assert found(spark, rows) == plain(rows)
    wide = spark.createDataFrame([(*r, 1, 2, "k", 4) for r in rows], SCHEMA + ", conv int, depth int, run string, pos int")
    assert sorted(map(tuple, prefix_trie.trie(wide).collect()), key=repr) == plain(rows)


def test_no_rows(spark):
    out = prefix_trie.trie(spark.createDataFrame([], SCHEMA))
    assert out.collect() == []
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found(spark, [(None, 1, "r", "t")]) == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_same_as_sql(spark, folder):
    assert differences(spark, "op11_prefix_trie", queries()["op11_prefix_trie"], oracle_sql()["op11_prefix_trie"], folder) == ""
