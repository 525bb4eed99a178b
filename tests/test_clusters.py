"""Clusters, components and profiles against plain versions."""

import numpy as np
import pytest

from visitloom.operators import clusters


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def plain_average(v, most):
    """Every pair of clusters compared anew after each merge."""
    v, groups = unit(v), [[i] for i in range(len(v))]
    while len(groups) > 1:
        far = [(1 - float(np.mean(v[a] @ v[b].T)), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        d, i, j = min(far)
        if d > most:
            break
        groups[i] += groups.pop(j)
    return groups


def plain_single(v, most):
    v, label = unit(v), list(range(len(v)))
    for i in range(len(v)):
        for j in range(i):
            if v[i] @ v[j] >= 1 - most and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def rows_of(rng, owner, n, first=0, centres=5, spread=0.5):
    c = rng.normal(size=(centres, 8))
    return [(owner, first + 3 * i, (c[i % centres] + spread * rng.normal(size=8)).tolist()) for i in range(n)]


def clustered(spark, rows, most):
    df = spark.createDataFrame(rows, "owner string, id long, v array<double>")
    return {(r["owner"], r["id"]): r["cluster"] for r in clusters.link_clusters(df, "owner", most).collect()}


@pytest.mark.parametrize("most", [0.2, 0.65])
def test_small_owners_by_average(spark, most):
    rng = np.random.default_rng(1)
    rows = rows_of(rng, "a", 60) + rows_of(rng, "b", 25) + rows_of(rng, "c", 1)
    want = {}
    for o in "abc":
        own = [r for r in rows if r[0] == o]
        for g in plain_average(np.array([r[2] for r in own]), most):
            want |= {(o, own[k][1]): own[min(g)][1] for k in g}
    assert clustered(spark, rows + [(None, 1, [1.0] * 8), ("a", None, [1.0] * 8), ("a", 999, None)], most) == want


@pytest.mark.parametrize(("most", "spread"), [(0.05, 0.1), (0.2, 0.5), (0.65, 1.0)])
def test_large_owners_by_chains(spark, monkeypatch, most, spread):
    monkeypatch.setattr(clusters, "LOCAL", 20)
    monkeypatch.setattr(clusters, "BLOCK", 16)
    monkeypatch.setattr(clusters, "SIDE", 2)
    rng = np.random.default_rng(2)
    rows = rows_of(rng, "a", 150, spread=spread) + rows_of(rng, "b", 70, centres=9, spread=spread) + rows_of(rng, "c", 15)
    rows += [("a", 5001, [0.0] * 8), ("a", 5002, rows[0][2]), ("a", 5004, rows[0][2])]
    want = {}
    for o in "ab":
        own = sorted((r for r in rows if r[0] == o), key=lambda r: r[1])
        label = plain_single(np.array([r[2] for r in own]), most)
        first = {}
        for x, r in zip(label, own, strict=True):
            first.setdefault(x, r[1])
            want[o, r[1]] = first[x]
    own = [r for r in rows if r[0] == "c"]
    for g in plain_average(np.array([r[2] for r in own]), most):
        want |= {("c", own[k][1]): own[min(g)][1] for k in g}
    assert clustered(spark, rows, most) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 52), (54, 52), (60, 60), (71, 70), (72, 70), (80, 72)]
    got = {r["node"]: r["component"] for r in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 52: 50, 54: 50} | {70: 70, 71: 70, 72: 70, 80: 70}
    assert clusters.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_profile(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=8), rng.normal(size=8)
    rows = [("d", i, (a + 0.25 * (i % 3) * b + 0.02 * rng.normal(size=8)).tolist(), i % 4) for i in range(12)]
    rows += [("d", 100 + i, (-a + 0.01 * rng.normal(size=8)).tolist(), 9) for i in range(30)]
    rows += [("e", i, (b + 0.01 * rng.normal(size=8)).tolist(), i) for i in range(3)] + [("f", 1, [1.0] * 8, 1), ("f", 2, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "owner string, id long, v array<double>, recording long")
    got = clusters.speaker_profile(df, most=0.65, near=0.02).orderBy("owner", "nth").collect()
    d = [r for r in got if r["owner"] == "d"]
    # The longer monologue is in one recording only; the one who recurs has as many prototypes as ways to sound.
    own = np.array([r[2] for r in rows[:12]])
    groups = sorted(plain_average(own, 0.02), key=lambda g: (-len(g), min(g)))[:4]
    assert {(r["cluster"], r["recordings"], r["size"]) for r in d} == {(0, 4, 12)} and len(d) == len(groups) >= 2
    for r, g in zip(d, groups, strict=True):
        assert r["n"] == len(g) and np.allclose(r["prototype"], unit(unit(own)[g].mean(axis=0)))
    e = [r for r in got if r["owner"] == "e"]
    assert [(r["nth"], r["n"]) for r in e] == [(1, 1), (2, 1), (3, 1)] and np.allclose([r["prototype"] for r in e], unit(np.array([r[2] for r in rows[42:45]])))
    assert not [r for r in got if r["owner"] == "f"]
