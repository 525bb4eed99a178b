"""Nearest vectors against all pairs."""

import numpy as np
import pytest

from visitloom.operators import linkage


def plain(ids, v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    s[ids[:, None] == ids[None, :]] = -9
    return {int(i): (int(ids[np.lexsort((ids, -row))[0]]), float(row.max())) for i, row in zip(ids, s, strict=True)}


@pytest.mark.parametrize("block", [2048, 16])
def test_exact(spark, monkeypatch, block):
    monkeypatch.setattr(linkage, "SIDE", 2)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 6))
    v[100] = v[3] * 2
    v[101] = v[3]
    ids = rng.permutation(150) * 7
    rows = [(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)] + [(None, [1.0] * 6), (5001, None)]
    got = {r["id"]: (r["neighbour"], r["cosine"]) for r in linkage.nearest(spark.createDataFrame(rows, "id long, v array<double>"), block).collect()}
    want = plain(ids, v)
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-8 for i in want)


def test_lists_find_most(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id id", "embedding v")
    rows = table.collect()
    want = plain(np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows], float))
    got = {r["id"]: (r["neighbour"], r["cosine"]) for r in linkage.nearest(table, block=128, exact=0).collect()}
    assert got.keys() == want.keys() and all(got[i][1] <= want[i][1] + 1e-6 for i in want)
    assert sum(got[i][0] == want[i][0] for i in want) >= 0.9 * len(want)


def test_a_meeting_holds_few_cosines_at_a_time():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from visitloom.operators import linkage

    v = np.random.default_rng(1).normal(size=(8192, 4))
    rows = pa.table({"side": pa.array([0]), "rows": pa.array([[{"id": i, "v": x} for i, x in enumerate(v.tolist())]], pa.list_(pa.struct([("id", pa.int64()), ("v", pa.list_(pa.float64()))])))})
    tracemalloc.start()
    out = linkage._best((pa.scalar(0), pa.scalar(0), pa.scalar(0)), rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 8192 and most < 32 << 20


def test_all_vectors_meet_at_any_size(spark):
    """Once, beyond a number of vectors only those met that shared a list."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id id", "embedding v")
    rows = table.collect()
    want = plain(np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows], float))
    got = {r["id"]: (r["neighbour"], r["cosine"]) for r in linkage.nearest(table, block=16, exact=0).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-9 for i in want)


@pytest.mark.parametrize("likely", [0, 16, 1 << 30])
def test_close_cosines_are_told_apart(monkeypatch, likely):
    monkeypatch.setattr(linkage, "LIKELY", likely)
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(40, 5)), 6, axis=0)
    v[:120] *= 1 + rng.integers(0, 3, size=(120, 1))  # copies
    v[120:] += rng.normal(size=(120, 5)) * 1e-4  # cosines that single precision can't tell apart
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.sort(rng.choice(np.arange(1000), 240, replace=False)).astype(np.int64)
    ids[7] = ids[6]
    a, b, c = linkage._likest(ids, v, ids, v)
    s = np.round(v @ v.T, 9)
    s[ids[:, None] == ids[None, :]] = -9
    assert a.tolist() == ids.tolist() and b.tolist() == ids[s.argmax(1)].tolist() and np.abs(c - s.max(1)).max() < 2e-9
    assert len(linkage._likest(ids[6:8], v[6:8], ids[6:8], v[6:8])[0]) == 0
