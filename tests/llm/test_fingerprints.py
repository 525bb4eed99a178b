"""Short texts: an edit that keeps half of a text leaves it more alike than another text is."""

import numpy as np
import pytest

from visitloom.llm import fingerprints as f


@pytest.mark.parametrize("n", [40, 64, 90, 127, 300, 1023, 1024])
def test_edited_is_nearer_than_next(n):
    rng = np.random.default_rng(n)
    bits_of = rng.integers(1, 200, 65536).astype(np.int32)
    near = []
    for _ in range(50):
        a, b = ("".join(rng.choice(list("abcdefghij klmno"), n)) for _ in range(2))
        x, y, z = (f.Digest(t.encode(), bits_of) for t in (a, f.edited(a, b), b))
        near.append((f.likeness(x, y), f.likeness(x, z)))
    assert np.mean([e > o for e, o in near]) >= 0.9
    assert np.mean([e for e, _ in near]) > 0.2


def plain_surprise(texts):
    n = np.zeros((256, 256))
    for t in texts:
        data = (t or "").encode()
        for a, b in zip(data, data[1:], strict=False):
            n[a, b] += 1
    return {(a, b): int(np.round(-16 * np.log2((n[a, b] + 1) / (n[a].sum() + 256)))) for a in range(256) for b in range(256)}


def plain_features(data, bits_of):
    """Windows that are rarer than those before and no less rare than those after, by looking at each."""
    out = []
    for width, wide in ([(8, 4)] if len(data) < 1024 else []) + ([(64, 32)] if len(data) > 64 else []):
        rarity = [sum(bits_of[data[i + j], data[i + j + 1]] for j in range(width - 1)) for i in range(len(data) - width + 1)]
        picked = [i for i, r in enumerate(rarity) if all(r > x for x in rarity[max(0, i - wide) : i]) and all(r >= x for x in rarity[i + 1 : i + wide + 1])]
        out += [data[i : i + width] for i in picked or [int(np.argmax(rarity))]]
    return out


def test_features_and_overlap_like_plain(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefghij kéß"), n)) for n in (30, 64, 65, 200, 1023, 1500, 20_000)] + ["aaaa" * 300, "", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, part string")
    table, plain = f.surprise(docs), plain_surprise(texts)
    assert all(table[a << 8 | b] == plain[a, b] for a, b in plain)
    digests = {}
    for i, t in enumerate(texts[:8]):
        data = t.encode()
        want = plain_features(data, plain)
        # As many features as different windows (apart from the same window in both widths), each bit set by one of them.
        d = digests[i] = f.Digest(data, table)
        assert d.n == len(set(want))
        assert f._features(data, table).tolist() == list(dict.fromkeys(int(f._windows(w, table, len(w), 1)[0]) for w in want))
    a, b = digests[5].filters, digests[4].filters
    if len(a) == len(b) == 1:
        na, nb, both = a.sum(), b.sum(), (a & b).sum()
        chance = na * nb / f.BITS
        assert f.likeness(digests[5], digests[4]) == pytest.approx(np.clip((both - chance) / (min(na, nb) - chance), 0, 1), abs=1e-6)
    got = {r.doc_id: r for r in f.compare_next(docs).collect()}
    for i in range(len(texts)):
        assert got[i].fingerprint == str(f.Digest((texts[i] or "").encode(), table))


def test_many_rows_without_an_id(spark):
    """Rows that share an id are cut by the hash of their text; each row's next one is as in one sorted list."""
    rows = [(None, f"text {i} of many words", "x") for i in range(300)] + [(i, f"other {i} text", "x") for i in range(50)] + [(7, "other 7 text", "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, guest string").repartition(5)
    hashed = docs.selectExpr("coalesce(doc_id, -9223372036854775808L) id", "xxhash64(text) h", "text").collect()
    order = [r.text for r in sorted(hashed, key=lambda r: (r.id, r.h, r.text))]
    import hashlib

    want = sorted(hashlib.sha256(f.edited(a, b).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1], strict=True))
    got = f.compare_next(docs)
    assert sorted(r.edited_sha256 for r in got.collect()) == want
    assert len(f._bounds(docs.selectExpr("coalesce(doc_id, -9223372036854775808L) id"), 8)) == 7
