"""Rules as rows: conditions meet facts in an inverted index, and a rule fires when all its clauses are met.

facts: visit_id, fact_id, kind, code, family, item_id, value, negated. A rule is the conjunction of its clauses, a clause
the disjunction of its conditions. However many rules there are, the plan is the same: facts join conditions on a term,
and clauses met are counted per visit and rule.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.operators.lineage import kept


class Condition(NamedTuple):
    """Facts with this term and a value that passes op and bound (none: any), and negated or not (None: either way).

    A term is kind|code, kind|* (any of the kind), kind|family:name, or rule|id (that rule has fired). absent: the clause
    is met where no fact is. bind: code, family or item_id; facts of a rule's bound conditions must agree in it, and it
    tells firings apart. shown: the fact is evidence.
    """

    rule_id: str
    clause: int
    term: str
    op: str | None = None
    bound: float | None = None
    absent: bool = False
    negated: bool | None = None
    bind: str | None = None
    shown: bool = True


class Rule(NamedTuple):
    """tests: those asked for; from_graph: those that the condition requires and that aren't done, too. only_missing:
    nothing fires if none is left."""

    rule_id: str
    severity: str
    condition: str | None = None
    tests: tuple[str, ...] = ()
    from_graph: bool = False
    only_missing: bool = False


CONDITION = "rule_id string, clause int, term string, op string, bound double, absent boolean, negated boolean, bind string, shown boolean"
RULE = "rule_id string, severity string, condition string, tests array<string>, from_graph boolean, only_missing boolean"

# The fourteen base rules, and the tests that conditions require.
BASE_RULES = [
    Rule("R01", "high", "preeclampsia", from_graph=True),
    Rule("R02", "high", "preeclampsia", ("urine_protein_test",)),
    Rule("R03", "high", "preeclampsia", from_graph=True, only_missing=True),
    Rule("R04", "medium", "gdm", from_graph=True),
    Rule("R05", "high", "preterm_labor", ("ctg", "obstetric_ultrasound")),
    Rule("R06", "critical"),
    Rule("R07", "medium", "infection", from_graph=True),
    Rule("R08", "high", "puerperal_infection", from_graph=True),
    Rule("R09", "critical"),
    Rule("R10", "low"),
    Rule("R11", "medium"),
    Rule("R12", "high", "preeclampsia"),
    Rule("R13", "high", "hypertension"),
    Rule("R14", "medium", "hypertension"),
]
BASE_CONDITIONS = [
    Condition("R01", 0, "context|pregnant", shown=False),
    Condition("R01", 1, "symptom|headache", negated=False),
    Condition("R01", 2, "symptom|blurred_vision", negated=False),
    Condition("R02", 0, "context|pregnant", shown=False),
    Condition("R02", 1, "vital|bp", ">=", 140),
    Condition("R02", 2, "lab|urine_protein", absent=True),
    Condition("R02", 3, "test|urine_protein_test", absent=True),
    Condition("R03", 0, "diagnosis|preeclampsia"),
    Condition("R04", 0, "diagnosis|gdm"),
    Condition("R04", 1, "lab|hba1c", absent=True),
    Condition("R04", 2, "test|hba1c_test", absent=True),
    Condition("R05", 0, "context|pregnant", shown=False),
    Condition("R05", 1, "symptom|reduced_fetal_movement", negated=False),
    Condition("R05", 2, "test|ctg", absent=True),
    Condition("R06", 0, "allergy|*", bind="family"),
    Condition("R06", 1, "medication|*", bind="family"),
    Condition("R07", 0, "diagnosis|infection"),
    Condition("R07", 1, "test|cbc", absent=True),
    Condition("R08", 0, "context|postpartum", shown=False),
    Condition("R08", 1, "symptom|fever", negated=False),
    Condition("R09", 0, "emergency|*"),
    Condition("R10", 0, "low_confidence|*", bind="item_id"),
    Condition("R11", 0, "persistent|*", bind="code"),
    Condition("R12", 0, "worsening|bp"),
    Condition("R13", 0, "medication|family:nsaid"),
    Condition("R13", 1, "diagnosis|hypertension"),
    Condition("R14", 0, "diagnosis|hypertension"),
    Condition("R14", 1, "vital|bp", ">=", 140),
]
REQUIRED = {
    "preeclampsia": ["bp_measurement", "urine_protein_test", "cbc", "liver_function"],
    "gdm": ["fasting_glucose", "hba1c_test"],
    "preterm_labor": ["ctg", "obstetric_ultrasound"],
    "infection": ["cbc", "blood_culture"],
    "puerperal_infection": ["cbc", "wound_exam", "blood_culture"],
}
OPS = {">=": Column.__ge__, ">": Column.__gt__, "<=": Column.__le__, "<": Column.__lt__, "=": Column.__eq__, "<>": Column.__ne__}


def base_rules(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The base rules, their conditions and the required tests as tables."""
    rules = [(*r[:3], list(r.tests), *r[4:]) for r in BASE_RULES]
    conditions = [(*c[:4], None if c.bound is None else float(c.bound), *c[5:]) for c in BASE_CONDITIONS]
    required = [(c, t) for c, tests in REQUIRED.items() for t in tests]
    return spark.createDataFrame(rules, RULE), spark.createDataFrame(conditions, CONDITION), spark.createDataFrame(required, "condition string, test string")


def strata(dependencies: list[tuple[str, str]]) -> dict[str, int]:
    """The stratum of each rule that reads another (rule, other): one above the highest that it reads; those not named
    are in 0. Rules that read each other in a ring are an error."""
    reads: dict[str, set[str]] = {}
    for rule, other in dependencies:
        reads.setdefault(rule, set()).add(other)
    out: dict[str, int] = {}
    left = dict(reads)
    while left:
        ready = {r: others for r, others in left.items() if not others & left.keys()}
        if not ready:
            raise ValueError(f"rules read each other: {sorted(left)}")
        out |= {r: 1 + max(out.get(o, 0) for o in others) for r, others in ready.items()}
        left = {r: o for r, o in left.items() if r not in ready}
    return out


def _terms(facts: DataFrame) -> DataFrame:
    kind = F.col("kind")
    family = F.when(F.col("family").isNotNull(), F.concat(kind, F.lit("|family:"), F.col("family")))
    return facts.withColumn("term", F.explode(F.array_compact(F.array(F.concat(kind, F.lit("|"), F.col("code")), F.concat(kind, F.lit("|*")), family))))


def clauses_met(facts: DataFrame, conditions: DataFrame) -> DataFrame:
    """visit_id, rule_id, dedupe, evidence: firings before tests are looked at, with evidence.

    One row a firing: dedupe is what its bound conditions agree in, empty without such; evidence the shown facts' ids in
    order.
    """
    test = reduce(or_, [(F.col("op") == name) & f(F.col("value"), F.col("bound")) for name, f in OPS.items()])
    state = F.col("c.negated").isNull() | (F.col("c.negated") == F.coalesce(F.col("f.negated"), F.lit(False)))
    f, c = _terms(facts).alias("f"), conditions.alias("c")
    bit = F.expr("shiftleft(1L, c.clause)")
    key = F.when(F.col("bind") == "code", F.col("f.code")).when(F.col("bind") == "family", F.col("f.family")).when(F.col("bind") == "item_id", F.col("f.item_id"))
    hits = f.join(c, "term").where((F.col("op").isNull() | F.coalesce(test, F.lit(False))) & state)
    hits = hits.select("f.visit_id", "c.rule_id", "c.absent", F.col("bind").isNotNull().alias("bound"), key.alias("key"), bit.alias("bit"), F.when(F.col("shown") & ~F.col("absent"), F.col("f.fact_id")).alias("fact_id"))
    hits = hits.where(F.col("key").isNotNull() | ~F.col("bound"))
    per = hits.groupBy("visit_id", "rule_id", "key").agg(F.coalesce(F.bit_or(F.when(~F.col("absent"), F.col("bit"))), F.lit(0)).alias("met"), F.max("absent").alias("blocked"), F.collect_set("fact_id").alias("evidence"))
    wanted = conditions.where("not absent").groupBy("rule_id").agg(F.coalesce(F.bit_or(F.when(F.col("bind").isNull(), F.expr("shiftleft(1L, clause)"))), F.lit(0)).alias("free"), F.coalesce(F.bit_or(F.when(F.col("bind").isNotNull(), F.expr("shiftleft(1L, clause)"))), F.lit(0)).alias("tied"))
    whole = per.where("key is null").select("visit_id", "rule_id", F.col("met").alias("free_met"), F.col("blocked").alias("stopped"), F.col("evidence").alias("free_evidence"))
    tied = per.where("key is not null").join(wanted.where("tied <> 0"), "rule_id").where((F.col("met") == F.col("tied")) & ~F.col("blocked")).join(whole, ["visit_id", "rule_id"], "left")
    tied = tied.where((F.coalesce("free_met", F.lit(0)) == F.col("free")) & ~F.coalesce("stopped", F.lit(False)))
    tied = tied.select("visit_id", "rule_id", F.col("key").alias("dedupe"), F.array_sort(F.array_union("evidence", F.coalesce("free_evidence", F.array().cast("array<long>")))).alias("evidence"))
    free = whole.join(wanted.where("tied = 0"), "rule_id").where((F.col("free_met") == F.col("free")) & ~F.col("stopped"))
    return tied.unionByName(free.select("visit_id", "rule_id", F.lit("").alias("dedupe"), F.array_sort("free_evidence").alias("evidence")))


def fire(facts: DataFrame, rules: DataFrame, conditions: DataFrame, required: DataFrame) -> DataFrame:
    """visit_id, rule_id, dedupe, severity, condition, evidence, missing, chain: each rule's firings, those of the same
    dedupe merged into one with all their evidence.

    Rules that read others come in strata of their own, after all that they read, and see those firings as facts. Only
    which rule reads which comes to the driver. missing: the rule's own tests, then those required of its condition and
    not done in the visit, in order of name. chain: the facts of evidence as kind:code, the rule, and what it asks for.
    A visit whose rules have absent clauses only never fires. Codes, kinds and families that are null meet nothing.
    """
    reads = conditions.where("term like 'rule|%'").select("rule_id", F.substring("term", 6, 1 << 20).alias("other")).distinct()
    layer_of = strata([(r["rule_id"], r["other"]) for r in reads.collect()])
    layers = max(layer_of.values(), default=0)
    every = None
    for layer in range(layers + 1):
        ids = [r for r, k in layer_of.items() if k == layer]
        mine = conditions.where(F.col("rule_id").isin(ids)) if layer else conditions.where(~F.col("rule_id").isin(list(layer_of)))
        seen = facts
        if layer:
            fired = every.select("visit_id", F.lit(None).cast("long").alias("fact_id"), F.lit("rule").alias("kind"), F.col("rule_id").alias("code"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("negated")).distinct()
            seen = facts.select(fired.columns).unionByName(fired)
        new = with_tests(clauses_met(seen, mine), facts, rules, required)
        new = kept(new) if layers else new
        every = new if every is None else every.unionByName(new)
    said = facts.select("visit_id", F.col("fact_id").alias("e"), F.concat("kind", F.lit(":"), F.coalesce("code", "family")).alias("said"))
    chain = every.select("visit_id", "rule_id", "dedupe", F.explode("evidence").alias("e")).join(said, ["visit_id", "e"]).groupBy("visit_id", "rule_id", "dedupe").agg(F.array_sort(F.collect_set("said")).alias("said"))
    out = every.join(chain, ["visit_id", "rule_id", "dedupe"], "left")
    asks = F.when(F.size("missing") > 0, F.concat(F.col("rule_id"), F.lit(" -> "), F.array_join("missing", ", "))).otherwise(F.col("rule_id"))
    return out.withColumn("chain", F.concat(F.coalesce("said", F.array().cast("array<string>")), F.array(asks))).drop("said")


def with_tests(fired: DataFrame, facts: DataFrame, rules: DataFrame, required: DataFrame) -> DataFrame:
    """Firings with what their rule says and the tests that it asks for."""
    none = F.array().cast("array<string>")
    known = fired.join(rules, "rule_id")
    done = facts.where("kind = 'test'").select("visit_id", F.col("code").alias("test")).distinct()
    open_tests = known.where("from_graph").select("visit_id", "condition").distinct().join(required, "condition").join(done, ["visit_id", "test"], "left_anti")
    listed = open_tests.groupBy("visit_id", "condition").agg(F.array_sort(F.collect_set("test")).alias("open"))
    both = known.join(listed, ["visit_id", "condition"], "left")
    missing = F.when(F.col("from_graph"), F.array_union(F.col("tests"), F.coalesce("open", none))).otherwise(F.col("tests"))
    return both.withColumn("missing", missing).where(~F.col("only_missing") | (F.size("missing") > 0)).select("visit_id", "rule_id", "dedupe", "severity", "condition", "evidence", "missing")


def bands(facts: DataFrame, table: DataFrame) -> DataFrame:
    """visit_id, code, holds: whether the last value of a code lies in a band.

    table: code, source (a fact's code), low, low_open, high, high_open; a null limit is none. Of several bands of one
    code any counts. The last value is that of the largest fact_id.
    """
    last = facts.where("value is not null").groupBy("visit_id", "code").agg(F.max_by("value", "fact_id").alias("value"))
    both = last.withColumnRenamed("code", "source").join(table, "source")
    v = F.col("value")
    above = F.col("low").isNull() | F.when(F.col("low_open"), v > F.col("low")).otherwise(v >= F.col("low"))
    below = F.col("high").isNull() | F.when(F.col("high_open"), v < F.col("high")).otherwise(v <= F.col("high"))
    return both.groupBy("visit_id", "code").agg(F.bool_or(above & below).alias("holds"))


def signs(facts: DataFrame, table: DataFrame) -> DataFrame:
    """visit_id, code, count, holds: how many of a code's signs a visit has, and whether they are enough.

    table: code, sign (a fact's code), least. Signs that are negated don't count; visits without any have no row.
    """
    have = facts.where("not coalesce(negated, false)").select("visit_id", F.col("code").alias("sign")).distinct()
    return have.join(table, "sign").groupBy("visit_id", "code").agg(F.count("*").alias("count"), (F.count("*") >= F.max("least")).alias("holds"))


def repeated(facts: DataFrame, reading: str, least: float, documented: str, times: int) -> DataFrame:
    """visit_id, count, holds: how often a reading was least or more, by what is there and by what the visit says of it
    (the last value of documented), whichever is more; and whether that is times or more."""
    counted = F.count_if((F.col("code") == reading) & (F.col("value") >= least))
    said = F.max_by(F.when(F.col("code") == documented, F.col("value")), F.when((F.col("code") == documented) & F.col("value").isNotNull(), F.col("fact_id")))
    per = facts.groupBy("visit_id").agg(F.greatest(counted, F.coalesce(F.floor(said), F.lit(0))).cast("long").alias("count"))
    return per.withColumn("holds", F.col("count") >= times)


# Bands of numeric facts (limits, then whether each is open), sets of signs with the least number of them,
# and facts that need several conditions; what follows # tells the ways to one fact apart.
BANDS = [
    ("maternal_age_under_14", "maternal_age", None, False, 14.0, True),
    ("maternal_age_under_16", "maternal_age", None, False, 16.0, True),
    ("parity_over_6", "parity", 6.0, True, None, False),
    ("early_pregnancy", "ga_weeks", None, False, 13.0, False),
    ("gestation_less_than_24_weeks", "ga_weeks", None, False, 24.0, True),
    ("gestation_less_than_32_weeks", "ga_weeks", None, False, 32.0, True),
    ("gestation_less_than_8_months", "ga_weeks", None, False, 32.0, True),
    ("gestation_8_months_or_more", "ga_weeks", 32.0, False, None, False),
    ("gestation_more_than_8_months", "ga_weeks", 32.0, True, None, False),
    ("gestation_24_to_34_weeks", "ga_weeks", 24.0, False, 34.0, False),
    ("trimester_2_or_3", "trimester", 2.0, False, 3.0, False),
    ("proteinuria_ge_3", "proteinuria_grade", 3.0, False, None, False),
    ("proteinuria_ge_2", "proteinuria_grade", 2.0, False, None, False),
    ("proteinuria_lt_2", "proteinuria_grade", None, False, 2.0, True),
    ("proteinuria_absent", "proteinuria_grade", None, False, 2.0, True),
    ("hemoglobin_lt_7", "hemoglobin_g_dl", None, False, 7.0, True),
    ("hemoglobin_7_to_11", "hemoglobin_g_dl", 7.0, False, 11.0, False),
    ("hemoglobin_gt_11", "hemoglobin_g_dl", 11.0, True, None, False),
    ("respiratory_rate_gt_30", "respiratory_rate", 30.0, True, None, False),
    ("labour_stage_active", "cervical_dilation_cm", 5.0, False, 10.0, True),
    ("labour_stage_second", "cervical_dilation_cm", 10.0, False, None, False),
    ("diastolic_bp_gt_90", "diastolic_bp", 90.0, True, None, False),
    ("fetal_heart_rate_abnormal", "fetal_heart_rate_bpm", None, False, 120.0, True),
    ("fetal_heart_rate_abnormal", "fetal_heart_rate_bpm", 160.0, True, None, False),
    ("second_stage_duration_ge_2h", "second_stage_duration_hours", 2.0, False, None, False),
    ("postpartum_first_hour", "postpartum_hours_since_birth", 0.0, False, 1.0, False),
    ("postpartum_hours_2_to_4", "postpartum_hours_since_birth", 2.0, False, 4.0, False),
    ("postpartum_hours_4_to_24", "postpartum_hours_since_birth", 4.0, True, 24.0, False),
]
ADVANCED = ["weight_loss_visible", "diarrhea_chronic", "cough_over_1_month", "shortness_of_breath", "itchy_rash", "herpes_zoster_rib_side", "lymphadenopathy", "oral_fissures", "abnormal_vaginal_discharge"]
SIGNS = [
    ("labour_stage_second", 1, ["perineum_bulging", "fetal_head_visible"]),
    ("obstructed_labour_sign", 1, ["transverse_lie", "continuous_contractions_no_rest", "constant_pain_between_contractions", "sudden_severe_abdominal_pain", "horizontal_abdominal_ridge", "labour_over_24h"]),
    ("dehydration_sign_count_ge_2", 2, ["thirst", "sunken_eyes", "dry_mouth", "slow_skin_pinch_return"]),
    ("delivery_extra_assistance_risk", 1, ["genital_warts_or_scars_obstructing", "previous_third_degree_tear", "third_trimester_bleeding_history", "previous_cesarean", "previous_forceps_delivery", "maternal_age_under_14"]),
    ("episiotomy_indication_present", 1, ["genital_warts_or_scars_obstructing", "previous_third_degree_tear", "breech_presentation", "shoulder_dystocia"]),
    ("severe_preeclampsia_symptom", 1, ["severe_headache", "blurred_vision", "epigastric_pain"]),
    ("newborn_resuscitation_needed", 1, ["newborn_not_breathing_or_gasping"]),
    ("postpartum_infection_additional_sign", 1, ["chills", "foul_vaginal_discharge", "lower_abdominal_pain", "fetal_tachycardia_30min", "rom_duration_gt_18h"]),
    ("postpartum_immediate_danger_sign", 1, ["pads_2_to_3_in_20_30min", "increasing_bleeding", "convulsions", "breathing_difficulty", "fever_with_severe_weakness", "severe_abdominal_pain"]),
    ("postpartum_early_review_sign", 1, ["mild_fever", "abdominal_pain", "breast_or_nipple_problem", "urinary_leakage", "foul_lochia", "severe_depression", "suicidal_ideation"]),
    ("high_hiv_exposure_risk", 1, ["high_hiv_exposure_risk", "partner_hiv_positive", "multiple_partners"]),
    ("advanced_hiv_sign_count_ge_1", 1, ADVANCED),
    ("advanced_hiv_sign_count_ge_2", 2, ADVANCED),
    ("hiv_risk_factor_count_ge_1", 1, ["occupational_exposure", "multiple_partners", "iv_drug_use", "previous_blood_transfusion", "partner_died_of_aids", "rape_history"]),
    ("danger_headache_visual_cluster", 2, ["severe_headache", "blurred_vision"]),
]
COMPOSITES = [
    Condition("danger_fever_weakness_cluster", 0, "fact|fever", negated=False),
    Condition("danger_fever_weakness_cluster", 0, "fact|temp", ">=", 38),
    Condition("danger_fever_weakness_cluster", 1, "fact|unable_to_stand", negated=False),
    Condition("labour_stage_latent", 0, "fact|cervical_dilation_cm", "<=", 5),
    Condition("labour_stage_latent", 1, "fact|cervical_dilation_cm", "<", 5),
    Condition("labour_stage_latent", 1, "fact|irregular_contractions", negated=False),
    Condition("active_stage_prolonged#first", 0, "fact|active_stage_duration_hours", ">", 12),
    Condition("active_stage_prolonged#later", 0, "fact|active_stage_duration_hours", ">", 10),
    Condition("active_stage_prolonged#later", 1, "fact|primipara", absent=True, negated=False),
    Condition("pneumonia_sign_count_ge_2#a", 0, "fact|temp", ">", 38),
    Condition("pneumonia_sign_count_ge_2#a", 0, "fact|temperature_gt_38", negated=False),
    Condition("pneumonia_sign_count_ge_2#a", 1, "fact|shortness_of_breath", negated=False),
    Condition("pneumonia_sign_count_ge_2#a", 1, "fact|chest_pain", negated=False),
    Condition("pneumonia_sign_count_ge_2#b", 0, "fact|shortness_of_breath", negated=False),
    Condition("pneumonia_sign_count_ge_2#b", 1, "fact|chest_pain", negated=False),
]


def derived_facts(facts: DataFrame) -> DataFrame:
    """visit_id, code, holds: what a visit's facts (visit_id, fact_id, code, value, negated) amount to.

    A band tells of each visit with a value of its source whether the last one lies in it; repeated readings tell of each
    visit; sets of signs and facts of several conditions have a row where they hold. Of several ways to a fact any counts.
    """
    spark = facts.sparkSession
    ranges = bands(facts, spark.createDataFrame(BANDS, "code string, source string, low double, low_open boolean, high double, high_open boolean"))
    counted = signs(facts, spark.createDataFrame([(c, s, least) for c, least, every in SIGNS for s in every], "code string, sign string, least int")).where("holds").select("visit_id", "code", "holds")
    twice = repeated(facts, "diastolic_bp", 90.0, "bp_readings_count", 2).select("visit_id", F.lit("bp_readings_at_least_2").alias("code"), "holds")
    # Of a number the last one counts, of temperatures the highest; of what is only said, that it is.
    newest = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("fact_id")))
    last = facts.groupBy("visit_id", "code", "negated").agg(F.when(F.col("code") == "temp", F.max("value")).otherwise(newest).alias("value"), F.max("fact_id").alias("fact_id"))
    as_facts = last.select("visit_id", "fact_id", F.lit("fact").alias("kind"), "code", F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("item_id"), "value", F.coalesce("negated", F.lit(False)).alias("negated"))
    table = spark.createDataFrame([(*c[:4], None if c.bound is None else float(c.bound), *c[5:]) for c in COMPOSITES], CONDITION)
    several = clauses_met(as_facts, table).select("visit_id", F.split_part("rule_id", F.lit("#"), F.lit(1)).alias("code"), F.lit(True).alias("holds"))
    every = ranges.unionByName(counted).unionByName(twice).unionByName(several)
    return every.groupBy("visit_id", "code").agg(F.bool_or("holds").alias("holds"))
