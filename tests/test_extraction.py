"""Full extraction on hand-made rows, one for each rule between mentions."""

import pytest

from visitloom.operators import extraction as ex

LEXICON = [
    ("symptom", "headache", "headache"), ("condition", "gdm", "sugar of pregnancy"), ("condition", "puerperal_infection", "childbed fever"), ("test", "ctg", "heart trace"), ("procedure", "follow_up_visit", "follow up"), ("procedure", "suture", "suture"),
    ("nutrition", "iron", "iron"), ("lab", "hemoglobin", "hemoglobin"), ("lab", "blood_glucose", "glucose"), ("drug", "ibuprofen", "ibuprofen"),
]
PATTERNS = [
    ex.Pattern("vital", "bp", r"pressure (\d+)/(\d+)", "mmHg", test="bp_measurement", short=True), ex.Pattern("clinical", "fetal_heart_rate_bpm", r"baby's pulse (\d+)", "bpm", group="pulse"), ex.Pattern("vital", "pulse", r"pulse (\d+)", "bpm", group="pulse", unless="baby"),
    ex.Pattern("lab", "blood_glucose", r"glucose reads (\d+)", "mg/dL", test="blood_glucose_test"), ex.Pattern("condition", "puerperal_infection", r"suspected childbed fever", status="suspected"), ex.Pattern("clinical", "trying_months", r"trying for (\d+) (?P<per>years|months)", "month", scale={"years": 12.0}),
    ex.Pattern("clinical", "hours_since_birth", r"born (\d+) (?P<per>days|hours) ago", "hour", scale={"days": 24.0}),
]
CASES = [
    ("headache today", "", {("symptom", "headache", "present")}),
    ("no headache today", "", {("symptom", "headache", "absent")}),
    ("suture", "plan", {("procedure", "suture", "planned")}),
    ("suture", "note", {("procedure", "suture", "present")}),
    ("no suture", "plan", {("procedure", "suture", "absent")}),
    ("appointment: follow up in 4 weeks if headache", "", {("procedure", "follow_up_visit", "present"), ("symptom", "headache", "hypothetical")}),
    ("if headache then follow up", "", {("procedure", "follow_up_visit", "hypothetical"), ("symptom", "headache", "hypothetical")}),
    ("childbed fever", "", {("condition", "puerperal_infection", "present", None)}),
    ("suspected childbed fever", "", {("condition", "puerperal_infection", "present", "suspected")}),
    ("glucose reads 140", "", {("lab", "blood_glucose", "present", None, 140.0), ("test", "blood_glucose_test", "present")}),
    ("glucose 99", "", {("lab", "blood_glucose", "present", "normal", 99.0), ("test", "blood_glucose_test", "present")}),
    ("no hemoglobin low", "", {("lab", "hemoglobin", "present", "low"), ("test", "hemoglobin_test", "present")}),
    ("no hemoglobin", "", {("lab", "hemoglobin", "absent", None), ("test", "hemoglobin_test", "present")}),
    ("ibuprofen and Xyzzol", "allergy", {("allergy", "ibuprofen", "present"), ("allergy", "unknown_drug", "present")}),
    ("ibuprofen and Xyzzol", "note", {("medication", "ibuprofen", "present")}),
    ("baby's pulse 150, pulse 80", "", {("clinical", "fetal_heart_rate_bpm", "present", None, 150.0), ("vital", "pulse", "present", None, 80.0)}),
    ("pressure 11/7", "", {("vital", "bp", "present", None, 110.0, 70.0), ("test", "bp_measurement", "present")}),
    ("trying for 3 years", "", {("clinical", "trying_months", "present", None, 36.0)}),
    ("born 2 days ago", "", {("clinical", "hours_since_birth", "present", None, 48.0)}),
    ("sugar of pregnancy, sugar of pregnancy", "", {("condition", "gdm", "present")}),
    ("  ", "", set()),
    (None, None, set()),
]
RULES = {"levels": {"low": ["low"], "high": ["high"]}, "ranges": {"blood_glucose": (70.0, 100.0)}, "units": {"hemoglobin": "g/dL"}}


def extracted(spark, cases):
    texts = spark.createDataFrame([(i, t, label) for i, (t, label, _) in enumerate(cases)], "id long, text string, label string")
    return ex.extract(texts, spark.createDataFrame(LEXICON, "kind string, code string, surface string"), PATTERNS, **RULES)


def test_each_rule(spark):
    got = {}
    for r in extracted(spark, CASES).collect():
        got.setdefault(r["id"], []).append((r["kind"], r["code"], r["assertion"], r["status"], r["value"], r["value2"]))
    for i, (text, label, want) in enumerate(CASES):
        mine = got.get(i, [])
        assert len(mine) == len(want), (text, label, mine)
        for w in want:
            assert any(m[: len(w)] == w for m in mine), (text, label, w, mine)


@pytest.mark.parametrize("sure", [True, False])
def test_scheduled_follow_up_stays_planned(spark, sure):
    """The cue of the condition is made to reach back, as it does where clauses are long."""
    text = ("appointment " if sure else "") + "follow up unless worse"
    texts = spark.createDataFrame([(1, text, "")], "id long, text string, label string")
    lexicon = spark.createDataFrame(LEXICON, "kind string, code string, surface string")
    got = ex.extract(texts, lexicon, [], cues={"hypothetical": [text.split()[0]]}, conditionals=("unless ",), scheduled=("appointment",)).collect()
    assert [r["assertion"] for r in got] == ["planned" if sure else "hypothetical"]


def test_refresh_replaces_edited_items(spark):
    lexicon = spark.createDataFrame(LEXICON, "kind string, code string, surface string")
    old = extracted(spark, CASES)
    edited = spark.createDataFrame([(0, "no iron and suture", "plan"), (1, "", ""), (99, "headache", "")], "id long, text string, label string")
    got = {}
    for r in ex.refresh(old, edited, lexicon, PATTERNS, **RULES).collect():
        got.setdefault(r["id"], set()).add((r["kind"], r["code"], r["assertion"]))
    assert got[0] == {("nutrition", "iron", "absent"), ("procedure", "suture", "absent")} and 1 not in got and got[99] == {("symptom", "headache", "present")}
    assert got[2] == {("procedure", "suture", "planned")} and len(got) == len({r["id"] for r in old.collect()} - {1}) + 1


def test_drugs(spark):
    texts = spark.createDataFrame([(1, "Ibuprofen, ibuprofen and Xyz-zol daily", "treatment"), (2, "Ibuprofen", "allergy"), (3, None, "allergy"), (4, "Xyzzol", "note")], "id long, text string, label string")
    got = sorted(tuple(r) for r in ex.drug_mentions(texts, spark.createDataFrame(LEXICON, "kind string, code string, surface string")).collect())
    assert got == [
        (1, "medication", "ibuprofen", "ibuprofen", 0, 9, 1.0), (1, "medication", "unknown_drug", "Xyz-zol", 25, 32, 0.4), (1, "medication", "unknown_drug", "ibuprofen", 11, 20, 0.4), (2, "allergy", "ibuprofen", "ibuprofen", 0, 9, 1.0),
    ]


def test_results_are_sent_on_by_portions(monkeypatch):
    """What is found is held for a few texts at a time, however many a batch has."""
    import pyarrow as pa

    monkeypatch.setattr(ex.lx, "CHUNK", 100)
    texts = ["Xyzzol " * 10] * 50 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["treatment"] * 52), pa.array(texts), pa.array([[]] * 52, pa.list_(pa.struct(ex.lx.HIT)))], ["label", "text", "hits"])
    out = list(ex._rest([])([batch]))
    assert max(b.num_rows for b in out) <= 3 and [len(x) for b in out for x in b.column(3).to_pylist()] == [10] * 50 + [0, 0]
