"""Facts from links, stages and contradictions by hand."""

from visitloom.operators import visits

LINKS = "item_id string, label string, is_urgent boolean, links array<struct<kind: string, code: string, assertion: string, status: string, value: double>>"


def test_facts_from_links(spark):
    items = [
        ("a", "note", None, [("vital", "blood_pressure", None, None, 120.0), ("vital", "bp", "absent", None, None), ("lab", "hemoglobin", "present", None, 9.5), ("lab", "hemoglobin", "present", None, None), ("procedure", "ctg", "planned", None, None), ("mood", "x", "present", None, None)]),
        ("b", "emergency", None, [("condition", "puerperal_infection", "present", "suspected", None), ("symptom", "water_breaking", "absent", "suspected", None), ("symptom", "puerperal_infection", "present", "suspected", None)]),
        ("c", "emergency", False, None), ("d", None, True, []), ("e", None, None, [(None, None, None, None, None), ("test", None, None, None, None)]),
    ]
    got = {}
    for r in visits.facts_from_links(spark.createDataFrame(items, LINKS)).collect():
        got.setdefault(r["item_id"], []).append(tuple(r)[1:])
    assert got == {
        "a": [("vital", "bp", False, 120.0, None), ("test_done", "bp_measurement", False, None, None), ("vital", "bp", True, None, None), ("lab", "hemoglobin", False, 9.5, None), ("clinical", "hemoglobin_g_dl", False, 9.5, None), ("lab", "hemoglobin", False, None, None)],
        "b": [("clinical", "suspected_puerperal_infection", False, None, "suspected"), ("clinical", "suspected_rupture_of_membranes", False, None, "suspected"), ("symptom", "puerperal_infection", False, None, "suspected"), ("emergency", "emergency", False, None, None)],
        "d": [("emergency", "emergency", False, None, None)], "e": [("test_done", "", False, None, None)],
    }


MARKERS = {"discharge": ["goes home"], "postpartum": ["after birth"], "newborn": ["newborn"], "third": ["placenta"], "second": ["pushing"], "labour": ["contractions"], "active": ["strong"], "latent": ["mild"], "pregnant": ["pregnant"]}


def test_stages(spark):
    rows = [
        (1, "pregnant, contractions", None, None, None, None, None), (2, "pregnant", [], None, None, None, None), (3, "pregnant, newborn cries", None, None, None, None, None), (4, "placenta and goes home", None, None, None, None, None),
        (5, "goes home", None, None, "third", None, None), (6, "contractions, 6 cm", None, None, None, None, None), (7, "10 cm", None, None, None, None, None), (8, "contractions, mild", None, None, None, "active", None),
        (9, "", None, "Pregnancy", None, None, None), (10, "pregnant", None, None, None, None, "not_pregnant"), (11, "pregnant", None, None, None, None, "postpartum"), (12, "x", ["postpartum"], None, None, None, "pregnant"), (13, "x", ["pregnancy"], None, None, None, None), (14, None, None, "latent_labour", None, None, None),
    ]
    df = spark.createDataFrame(rows, "visit_id long, text string, labels array<string>, stage string, delivery_phase string, labour_stage string, effective_status string")
    got = {r["visit_id"]: tuple(r)[1:] for r in visits.visit_stage(df, MARKERS, r"(\d+) cm", ["pregnancy"]).collect()}
    assert got == {
        1: (None, None, True, False, False, False), 2: (None, None, False, False, False, True), 3: ("newborn", None, False, True, False, False), 4: ("discharge", None, False, True, True, False), 5: ("third", None, False, True, False, False),
        6: (None, "active", True, False, False, False), 7: ("second", None, False, True, False, False), 8: (None, "active", True, False, False, False), 9: (None, None, False, False, False, True), 10: (None, None, False, False, False, False),
        11: (None, None, False, False, True, False), 12: ("postpartum", None, False, True, True, False), 13: (None, None, False, False, False, True), 14: (None, "latent", True, False, False, False),
    }


def test_contradictions(spark):
    rows = [(1, "age 20, birth 25 years", 20, 30, 31), (2, "age 20, birth 5 years", 22, 30, 28), (3, "birth 50 years", 20, None, 3), (4, None, 20, 30, 29), (5, "age 20, birth 20 years", 21, 30, None)]
    df = spark.createDataFrame(rows, "visit_id long, text string, record_age int, weeks_before int, weeks int")
    got = {r["visit_id"]: r["warnings"] for r in visits.consistency_warnings(df, r"age (\d+)", r"birth (\d+) years").collect()}
    assert got == {1: ["birth_before_age"], 2: ["age_differs", "week_goes_back"], 3: [], 4: [], 5: ["birth_before_age"]}
