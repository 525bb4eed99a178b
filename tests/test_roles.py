"""Each way to a role by hand."""

import numpy as np

from visitloom.operators import roles, vectors


def test_roles(spark):
    rows = [
        (1, "a", 0.5, None), (2, "a", -0.5, 0.9), (3, "a", 0.1, None),  # alone
        (4, "a", 1.0, None), (4, "b", -1.0, None),  # by text
        (5, "a", 0.0, 0.8), (5, "b", 0.0, 0.2),  # by voice
        (6, "a", 0.1, 0.50), (6, "b", 0.0, 0.45),  # too close
        (7, "a", -0.5, 0.9), (7, "b", 0.5, 0.1),  # text and voice disagree: half the lead
        (8, "a", 1.0, 0.9), (8, "b", -1.0, None),  # one voice is missing: text alone
    ]
    got = {(r["job_id"], r["cluster"]): (r["role"], r["basis"], r["margin"], r["confidence"]) for r in roles.assign_roles(spark.createDataFrame(rows, "job_id long, cluster string, text double, voice double")).collect()}
    assert got == {
        (1, "a"): ("doctor", "text", 0.0, 0.5), (2, "a"): ("patient", "text", 0.0, 0.5), (3, "a"): ("unknown", "fallback", 0.0, 0.1),
        (4, "a"): ("doctor", "text", 1.0, 1.0), (4, "b"): ("patient", "text", 1.0, 1.0),
        (5, "a"): ("doctor", "voice", 0.21, 0.71), (5, "b"): ("patient", "voice", 0.21, 0.71),
        (6, "a"): ("unknown", "fallback", 0.0325, 0.0), (6, "b"): ("unknown", "fallback", 0.0325, 0.0),
        (7, "a"): ("doctor", "voice+text", 0.065, 0.565), (7, "b"): ("patient", "voice+text", 0.065, 0.565),
        (8, "a"): ("doctor", "text", 1.0, 1.0), (8, "b"): ("patient", "text", 1.0, 1.0),
    }


def test_markers_weigh_1_2_2(spark):
    texts = spark.createDataFrame([("a", "Why? take rest"), ("a", "rest"), ("b", "it hurts? hurts"), ("c", "x"), ("c", None)], "cluster string, text string")
    got = {r["cluster"]: r["score"] for r in roles.text_role_score(texts, ["?"], ["rest"], ["hurts"]).collect()}
    assert got == {"a": 1.0, "b": -0.6, "c": 0.0}


def test_only_the_unsure_are_scored_again(spark):
    x = np.array([[9.0, 0.0], [0.2, 0.1], [0.0, 9.0], [0.1, 0.3]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0, 1.0]), (9, None)], "id long, v array<double>").repartition(3)

    def model(a):
        p = np.exp(a - a.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    got = {r["id"]: r for r in vectors.score(df, model, passes=6).collect()}
    assert {i: r["scored"] for i, r in got.items()} == {0: 1, 1: 7, 2: 1, 3: 7}
    for i in (1, 3):
        masks = np.stack([vectors.seeded_mask(np.array([i]), k, 2)[0] for k in range(6)])
        want = np.stack([model(x[i : i + 1] * m)[0] for m in masks]).var(axis=0).mean()
        assert abs(got[i]["variance"] - want) < 1e-7
    assert got[0]["variance"] == 0.0 and got[0]["label"] == 0 and got[3]["label"] == 1
