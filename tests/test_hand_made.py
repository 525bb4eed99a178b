"""Operators on hand-made rows whose answers are known."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from visitloom.functions import text
from visitloom.operators import aggregates, discourse, filters, linkage, mentions, phrases, routing, rules, states, updates, vectors

T0 = datetime(2024, 1, 1)
OBS = "patient_id long, effective_at timestamp, created_at timestamp, pregnant boolean, postpartum boolean, ga_weeks int"


def test_state_as_of(spark):
    rows = [
        (1, T0, T0, True, False, 30),
        (2, T0, T0, True, False, None),
        (2, T0 + timedelta(days=3), T0, None, True, None),
        (3, T0, T0, True, False, 10),
        (3, T0, T0 + timedelta(hours=1), False, False, None),
        (4, T0, T0, None, False, None),
    ]
    obs = states.state_observation(spark.createDataFrame(rows, OBS))
    moments = [(1, 10, T0), (1, 11, T0 + timedelta(days=28)), (1, 12, T0 + timedelta(days=1100)), (1, 13, T0 - timedelta(days=1)), (2, 20, T0 + timedelta(days=4)), (2, 21, T0 + timedelta(days=60)), (3, 30, T0 + timedelta(days=1)), (4, 40, T0), (9, 90, T0)]
    got = {r.moment_id: (r.status, r.weeks) for r in states.state_as_of(obs, spark.createDataFrame(moments, "patient_id long, moment_id long, at timestamp")).collect()}
    assert got == {10: ("pregnant", 30), 11: ("pregnant", 34), 12: ("unknown", None), 13: ("unknown", None), 20: ("postpartum", None), 21: ("unknown", None), 30: ("unknown", None), 40: ("unknown", None), 90: ("unknown", None)}


def test_recent_history_leaves_out_later_visits_and_itself(spark):
    rows = [(k, 1, "complete" if k != 3 else "queued", T0 + timedelta(days=k // 2)) for k in range(8)]
    got = {r.job_id: r.history for r in states.recent_history(spark.createDataFrame(rows, "job_id long, patient_id long, status string, visit_at timestamp"), 3).collect()}
    assert got[0] == got[1] == [] and got[2] == [0, 1] and got[6] == [2, 4, 5] and got[7] == [2, 4, 5]


def test_turn_with_the_largest_overlap(spark):
    segments = spark.createDataFrame([("r", 0, 0.0, 10.0), ("r", 1, 100.0, 101.0), ("r", 2, 28.0, 34.0)], "recording string, seg int, start double, end double")
    turns = spark.createDataFrame([("r", 0, "A", 0.0, 5.0), ("r", 1, "B", 5.0, 10.0), ("r", 2, "C", 29.0, 40.0)], "recording string, turn int, cluster string, from_ double, to_ double")
    got = {r.seg: (r.cluster, r.overlap) for r in linkage.assign_turn(segments, turns).collect()}
    assert got == {0: ("A", 5.0), 1: (None, None), 2: ("C", 5.0)}


def test_conditional_scope(spark):
    flags = [(1, 0, True, False, False, False), (1, 1, False, False, True, False), (1, 2, False, True, False, False), (1, 3, False, False, True, False), (1, 4, True, False, False, False), (1, 5, False, False, False, False), (1, 6, False, False, True, False)]
    got = [r.tag for r in discourse.conditional_scope(spark.createDataFrame(flags, "job_id long, order_index long, opens boolean, closes boolean, joins boolean, danger boolean")).orderBy("order_index").collect()]
    assert got == ["condition", "condition", "action", "none", "condition", "none", "none"]


def test_merge_short(spark):
    rows = [(1, 0, "A", "yes", 0.9, False), (1, 1, "A", "it hurts since the morning", 0.4, True), (1, 2, "B", "ok", 0.8, False), (1, 3, "A", "no", 0.7, False)]
    got = [(r.order_index, r.speaker, r.text, r.confidence, r.is_suspect) for r in discourse.merge_short(spark.createDataFrame(rows, "job_id long, order_index long, speaker string, text string, confidence double, is_suspect boolean")).orderBy("order_index").collect()]
    assert got == [(0, "A", "yes it hurts since the morning", 0.4, True), (1, "B", "ok", 0.8, False), (2, "A", "no", 0.7, False)]


def test_split_keeps_all_words_and_times(spark):
    text = " ".join(["word"] * 100)
    parts = discourse.split_by_count(spark.createDataFrame([(1, text, 0.0, 50.0)], "id long, text string, start double, end double"), 140).orderBy("part").collect()
    assert " ".join(p.text for p in parts) == text and max(len(p.text) for p in parts) <= 140
    assert parts[0].start == 0.0 and parts[-1].end == 50.0 and all(a.end == b.start for a, b in zip(parts, parts[1:], strict=False))


def test_split_sizes(spark):
    rows = [(i, "x" if i < 20 else "y" if i < 23 else "z") for i in range(24)]
    got = discourse.stratified_split(spark.createDataFrame(rows, "id long, label string"), "label", "id", "7").groupBy("label", "part").count().collect()
    assert {(r.label, r.part): r["count"] for r in got} == {("x", "test"): 3, ("x", "val"): 3, ("x", "train"): 14, ("y", "test"): 1, ("y", "val"): 1, ("y", "train"): 1, ("z", "train"): 1}


@pytest.mark.parametrize(
    ("text", "want"),
    [("no sign of fever today", "absent"), ("if there is fever call", "hypothetical"), ("my mother had fever", "family"), ("there was pain, fever now", "present"), ("she had fever", "historical"), ("we will check fever", "planned"), ("fever", "present"), ("temperature 38.5 fever, not cough", "present"), ("fever denied by all", "absent"), ("fever mild, cough denied", "present"), ("no doubt fever", "present"), ("a lack of fever", "absent"), ("a lack of any fever", "present"), ("no cough but fever", "present"), ("fever if at all", "present"), ("\u00d1o fever", "present"), ("n\u00f3 fever", "present"), ("no\u0301 fever", "absent"), ("no " + "x" * 40 + " fever", "present")],
)
def test_assertion(spark, text, want):
    at = text.index("fever")
    row = spark.createDataFrame([(text, at, at + 5)], "text string, b int, e int")
    assert row.select(mentions.assertion(F.col("text"), F.col("b"), F.col("e"))).first()[0] == want


def test_affirmed_mentions(spark):
    rows = [(1, "no fever", 3, 8), (1, "no fever. fever", 10, 15), (2, "no fever", 3, 8)]
    got = {(r.id, r.found, r.affirmed) for r in mentions.find_affirmed(spark.createDataFrame(rows, "id long, text string, begin int, end int")).collect()}
    assert got == {(1, 2, True), (2, 1, False)}


@pytest.mark.parametrize(
    ("text", "want"),
    [("iron high today", ("high", None)), ("iron not high, 9", (None, None)), ("iron 9,5 low", ("low", 9.5)), ("iron normal but pressure high", ("normal", None)), ("no trouble at all, iron low", ("low", None)), ("iron " + "x" * 40 + " high 7", (None, None)), ("high iron low 3 4", ("high", 3.0)), ("iron", (None, None))],
)
def test_lab_values(spark, text, want):
    at = text.index("iron")
    row = spark.createDataFrame([(text, at, at + 4)], "text string, begin int, end int")
    got = mentions.lab_values(row, {"high": ["high"], "low": ["low"], "normal": ["normal"]}).first()
    assert (got.qualifier, got.value) == want


@pytest.mark.parametrize(
    ("raw", "candidate", "want", "status"),
    [
        ("she takes 5 mg of iron", "she takes 5 mg of iron daily", [], "accepted"),
        ("she takes 5 mg of iron", "she takes 5 mg of iron", [], "unchanged"),
        ("she takes 5 mg of iron", None, None, "failed"),
        ("short", "other", None, "not_eligible"),
        ("she takes 5 mg of iron", " ", ["empty"], "rejected"),
        ("she takes 5 mg of iron", "she takes 7 kg of iron", ["numbers", "units"], "rejected"),
        ("she takes 5 mg of iron", "he takes 5 mg of iron?", ["question", "gender"], "rejected"),
        ("she takes 5 mg of iron", "she has not 5 mg of zinc", ["scope", "lost", "new"], "rejected"),
        ("iron was very high today", "iron was high today", ["qualifiers"], "rejected"),
        ("she takes 5 mg of iron", "5 mg iron", ["length"], "rejected"),
        ("she takes 5 mg of iron", "she takes 5 mg of iron, cancer", ["sensitive"], "rejected"),
    ],
)
def test_guard(spark, raw, candidate, want, status):
    row = spark.createDataFrame([(raw, candidate)], "raw string, candidate string")
    parts = {"high": ["high"], "very": ["very high"]}, {"iron": ["iron"], "zinc": ["zinc"]}, {"f": ["she"], "m": ["he"]}, {"cancer": ["cancer"]}
    reasons = mentions.guard(F.col("raw"), F.col("candidate"), ["mg", "kg"], {"negated": ["not"]}, *parts)
    got = row.withColumn("reasons", reasons).withColumn("status", mentions.guard_status(F.col("raw"), F.col("candidate"), F.length("raw") > 5, F.col("reasons"))).first()
    assert got.status == status and (want is None or got.reasons == want)


def test_signatures(spark):
    row = spark.createDataFrame([("is it 9,5 or \u0663\u066b\u0665? very high, then high",)], "c string")
    got = row.select(text.numeric_sig(F.col("c")).alias("n"), text.speech_sig(F.col("c")).alias("q"), text.qualifier_sig(F.col("c"), {"h": ["high"], "v": ["very high"]}).alias("s")).first()
    assert (got.n, got.q, got.s) == (["9.5", "3.5"], True, ["v", "h"])


def test_archive_tells_new_objects(spark):
    new = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary")
    known = new.where("content = X'62'").select(F.sha2("content", 256).alias("sha256"))
    got = {(r.size, r.was_new, r.key.endswith(r.sha256)) for r in updates.archive(new, known).collect()}
    assert got == {(1, True, True), (1, False, True)} and updates.archive(new, known).count() == 2


def test_gazetteer_is_longest_first(spark):
    rows = [("lab", "hb", "Hb", "haemoglobin", "blood", "g", 11.0), ("lab", "hb", "haemoglobin", "haemoglobin", "blood", "g", 16.0), ("lab", "fe", "iron", "iron", None, None, None)]
    got = [(r.surface, r.low, r.high) for r in mentions.gazetteer(spark.createDataFrame(rows, "kind string, code string, surface string, name string, family string, unit string, value double")).collect()]
    assert got == [("haemoglobin", 11.0, 16.0), ("iron", None, None), ("hb", 11.0, 16.0)]


LINK = "array<struct<kind: string, code: string, assertion: string, value: double, value2: double>>"
MEANT = {"emergency": "assessment", "diagnosis": "assessment", "follow_up": "plan"}


@pytest.mark.parametrize(
    ("labels", "said", "links", "want"),
    [
        (["diagnosis"], "", [("context", "plan_continuation", "present", None, None)], ("plan", ["assessment"])),
        (["diagnosis"], "", [("symptom", "s", "hypothetical", None, None), ("lab", "l", "hypothetical", None, None)], ("plan", ["assessment"])),
        (["diagnosis"], "", [("symptom", "s", "hypothetical", None, None), ("lab", "l", "present", None, None)], ("assessment", [])),
        (["diagnosis"], "we plan", [], ("plan", ["assessment"])),
        (["diagnosis"], "", [("vital", "cervical_dilation_cm", "present", 4.0, None)], ("objective", ["assessment"])),
        (["emergency"], "", [("symptom", "s", "absent", None, None)], ("subjective", ["assessment"])),
        (["emergency"], "", [], ("assessment", [])),
        (["diagnosis"], "she says", [("symptom", "s", "present", None, None)], ("subjective", ["assessment"])),
        (["diagnosis"], "she says", [("symptom", "s", "present", None, None), ("condition", "c", "suspected", None, None)], ("assessment", [])),
        (["follow_up"], "moves", [], ("subjective", ["plan"])),
        (["diagnosis", "follow_up"], "", None, ("plan", ["assessment"])),
        (None, "", None, ("subjective", [])),
    ],
)
def test_route_item(spark, labels, said, links, want):
    row = spark.createDataFrame([(labels, said, links)], f"labels array<string>, said string, links {LINK}")
    wording = {"plan": F.col("said") == "we plan", "exam": F.col("said") == "exam", "reported": F.col("said") == "she says", "movement": F.col("said") == "moves"}
    got = routing.route_item(row, MEANT, wording).first()
    assert (got.section, got.also) == want


def test_urgent(spark):
    rows = [
        (["emergency"], [], None, True),
        (["emergency"], [("symptom", "s", "absent", None, None)], False, False),
        (["emergency"], [("symptom", "s", "present", None, None)], False, True),
        (["diagnosis"], [("vital", "bp", "present", 120.0, 110.0)], False, True),
        (["diagnosis"], [("vital", "bp", "absent", 170.0, None)], False, False),
        (["diagnosis"], [("vital", "bp", "present", 159.0, None)], False, False),
        (None, None, True, True),
        (None, None, None, False),
    ]
    got = spark.createDataFrame(rows, f"labels array<string>, links {LINK}, said boolean, want boolean").select("want", routing.is_urgent(F.col("said")).alias("urgent")).collect()
    assert [r.urgent for r in got] == [r.want for r in got]


def test_review_queue(spark):
    rows = [("a", 1, 0.1, 0.95, False), ("b", 1, 0.2, 0.9, False), ("c", 1, 0.9, 0.4, False), ("d", 1, None, 0.1, False), ("e", 1, 1.0, 0.1, True)]
    got = filters.review_queue(spark.createDataFrame(rows, "item_id string, job_id long, review_priority double, confidence double, is_corrected boolean"), 10)
    assert [r.item_id for r in got.collect()] == ["c", "b", "a", "d"]


def test_sync_suggestions(spark):
    old = spark.createDataFrame([("j", "R1", "old1", "info"), ("j", "R2", "old2", "info")], "job_id string, rule_id string, id string, severity string")
    new = spark.createDataFrame([("j", "R2", "high"), ("j", "R3", "low")], "job_id string, rule_id string, severity string")
    got = {r.rule_id: (r.id, r.severity, r.is_active) for r in updates.sync_suggestions(old, new, ["job_id", "rule_id"]).collect()}
    assert got["R1"] == ("old1", "info", False) and got["R2"] == ("old2", "high", True) and got["R3"][1:] == ("low", True)


def test_rules_need_and_exclude(spark):
    facts = spark.createDataFrame([("v", "a"), ("v", "b"), ("w", "b"), ("w", "c")], "visit_id string, code string")
    got = {(r.visit_id, r.rule_id) for r in rules.stratified(facts, [[("A", rules.has("a"), [], [])], [("B", rules.has("b"), ["A"], []), ("C", rules.has("c"), [], ["A"])]]).collect()}
    assert got == {("v", "A"), ("v", "B"), ("w", "C")}


def test_auroc_of_ties_is_half(spark):
    rows = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (2.0, False)], "score double, positive boolean")
    assert aggregates.auroc(rows).first()[0] == 0.5


def test_calibration_finds_the_temperature(spark):
    rows = [(i, 0 if i % 4 else 1, [4.0, 0.0]) for i in range(400)]
    best = vectors.calibrate(spark.createDataFrame(rows, "id long, gold int, logits array<double>"), steps=24).first()
    assert best.temperature > 1 and best.ece < 0.05


def test_unknown_zone_is_utc(spark):
    now = F.lit("2024-03-05 12:00:00").cast("timestamp")
    start, end = spark.range(1).select(*filters.local_day_bounds("Nowhere/At_All", now)).first()
    assert (start, end) == (datetime(2024, 3, 5), datetime(2024, 3, 6))


def test_cut_is_floored_and_not_rounded(spark):
    """A confidence of 0.8996 doesn't reach a cut of 0.9."""
    rows = spark.createDataFrame([(0.9001, True)] * 6 + [(0.8996, False)] * 4, "conf double, hit boolean")
    assert aggregates.threshold_for_precision(rows).first()[0] == 0.9
    assert aggregates.threshold_for_precision(rows, 0.6, 0.9).first()[0] == 0.899


def test_suggestion_needs_an_underscore(spark):
    rows = spark.createDataFrame([(["plan", "subplan"],), (["plan", "care_plan"],), (["allergy", "x_allergy"],)], "labels array<string>")
    assert [r[0] for r in rows.select(aggregates.suggestion(F.col("labels"), ["allergy"])).collect()] == [None, "care_plan", None]


def test_mined_phrases(spark):
    rows = [(i, "pain of the back pain of the back") for i in range(3)] + [(9, "of the of"), (10, "sore throat"), (11, "sore throat"), (12, "sore throat sore")]
    known = spark.createDataFrame([("Sore throat",)], "phrase string")
    got = {(r.phrase, r.n) for r in phrases.mine_phrases(spark.createDataFrame(rows, "id long, text string"), ["of", "the"], 3, 50, known).collect()}
    assert got == {("pain of the back", 6), ("back pain of the", 3), ("of the back pain", 3)}


def test_rule_check_names_every_problem(spark):
    fired = spark.createDataFrame([("v", "A1"), ("v", "B1"), ("w", "C1")], "visit_id string, rule_id string")
    pair = "visit_id string, rule_id string"
    prefixes = spark.createDataFrame([(f"Z{i}",) for i in range(1500)] + [("B",)], "prefix string")
    needed = spark.createDataFrame([("v", "A"), ("w", "A")], "visit_id string, prefix string")
    got = {tuple(r) for r in linkage.check_rules(fired, spark.createDataFrame([("v", "A2")], pair), spark.createDataFrame([("w", "C1")], pair), prefixes, needed).collect()}
    assert got == {("v", "A2", "missing"), ("w", "C1", "forbidden"), ("v", "B1", "leaked"), ("w", "A", "absent")}


def test_directions_of_tfidf_keep_the_similarities(spark):
    import numpy as np

    texts = [(i, " ".join(w)) for i, w in enumerate([["ab", "cd", "ef"], ["ab", "cd", "gh"], ["xy", "zw", "uv"], ["xy", "zw", "ab"], ["ef", "gh", "uv"]] * 3)]
    rows = spark.createDataFrame(texts, "id long, text string")
    v = np.array([r.v for r in vectors.char_tfidf(rows, most=12, vocabulary=256).orderBy("id").collect()])
    full = np.array([r.v for r in vectors.char_tfidf(rows, most=200, vocabulary=256).orderBy("id").collect()])
    assert v.shape == (15, 12) and np.allclose(v @ v.T, full @ full.T, atol=1e-6)


def test_columns_of_ngrams_are_those_of_hashing_tf(spark):
    import numpy as np
    from pyspark.ml.feature import HashingTF

    grams = [" a ", "éa", "abcd", "😀x", " ", "ßßß", "xyzw"]
    table = HashingTF(inputCol="g", outputCol="v", numFeatures=4096).transform(spark.createDataFrame([([g],) for g in grams], "g array<string>"))
    assert [int(r["v"].indices[0]) for r in table.collect()] == [vectors.murmur(g.encode()) % 4096 for g in grams]
    rows = spark.createDataFrame([(1, "ab cd"), (2, None), (3, "ab ab"), (4, "")], "id long, text string")
    got = {r.id: r.v for r in vectors.char_tfidf(rows, most=3, vocabulary=64).collect()}
    assert len(got) == 4 and not np.any(got[2]) and not np.any(got[4])


def test_nearest_over_many_parts(spark):
    import numpy as np

    from visitloom.operators import linkage

    m = np.random.default_rng(3).integers(-4, 5, (40, 5)).astype(float)
    m[7] = m[3]
    m[:, 0] += 9
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    table = spark.createDataFrame([*rows, (99, None), (None, rows[0][1])], "id long, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    want = {i: int(k) for i, k in enumerate(s.argmax(1))}
    for block in (6, 100):
        assert {r.id: r.neighbour for r in linkage.nearest(table, block).collect()} == want
    assert linkage.nearest(table.limit(0)).count() == 0
