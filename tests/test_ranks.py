"""Running sums and quantiles against numpy."""

import numpy as np
from pyspark.sql import functions as F

from visitloom.operators import ranks, vectors


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), float(x), int(n)) for i, (x, n) in enumerate(zip(rng.permutation(500) / 7, rng.integers(0, 9, 500), strict=True))]
    df = spark.createDataFrame(rows, "id long, x double, n int").repartition(5)
    got = {r["id"]: r["before_n"] for r in ranks.running(df, [F.col("x").desc()], ["n"]).collect()}
    total = 0
    for i, _, n in sorted(rows, key=lambda r: -r[1]):
        assert got[i] == total
        total += n
    assert ranks.running(df.limit(0), ["x"], ["n"]).count() == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=301).round(2), np.array([1.0]), np.array([3.0, 3.0, 5.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        shares = [0.0, 0.25, 0.5, 0.995, 1.0]
        assert np.allclose(ranks.quantiles(df, "v", shares), np.quantile(values, shares))
    assert ranks.quantiles(df.where("false"), "v", [0.5]) == [None]


def test_mahalanobis(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    cov = np.cov(x.T)
    precision = np.linalg.pinv(cov + 1e-3 * np.eye(5) * np.trace(cov) / 5)
    want = np.sqrt(np.einsum("ij,jk,ik->i", x - x.mean(0), precision, x - x.mean(0)))
    got = {r["id"]: r["distance"] for r in vectors.mahalanobis(df).collect()}
    assert np.allclose([got[i] for i in range(80)], want, atol=1e-5)
