"""Queries of rules as rows, over coded facts that events stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.operators import rulebase as o
from visitloom.plans.bindings import DAY
from visitloom.plans.registry import Tables, query

# What events of each type stand for, by their k.
SYMPTOMS = ["headache", "blurred_vision", "fever", "reduced_fetal_movement"]
DIAGNOSES = ["preeclampsia", "gdm", "infection", "hypertension"]
CONTEXTS = ["pregnant", "postpartum"]
FAMILIES = ["nsaid", "penicillin"]
TESTS = ["ctg", "cbc", "urine_protein_test", "hba1c_test", "blood_culture"]
LABS = ["urine_protein", "hba1c"]
OTHERS = ["allergy", "medication", "test", "lab", "emergency", "low_confidence", "persistent", "worsening"]
CODES = {"click": SYMPTOMS, "purchase": DIAGNOSES, "signup": CONTEXTS, "view": ["bp"]}
KINDS = {"click": "symptom", "purchase": "diagnosis", "signup": "context", "view": "vital"}


def _pick(values: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def coded_facts(t: Tables) -> DataFrame:
    """Facts of a patient's week."""
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    other, nth = _pick(OTHERS, k), F.floor(k / len(OTHERS))
    as_kind = F.coalesce(*[F.when(kind == e, v) for e, v in KINDS.items()], other)
    code = F.coalesce(*[F.when(kind == e, _pick(v, k)) for e, v in CODES.items()], F.when(other == "test", _pick(TESTS, nth)), F.when(other == "lab", _pick(LABS, nth)), F.when(other == "persistent", _pick(SYMPTOMS, nth)), F.when(other == "worsening", "bp"), F.when(other == "emergency", "flag"))
    week = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / (7 * DAY))
    return t.events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), week.cast("string")).alias("visit_id"),
        F.col("event_id").alias("fact_id"),
        as_kind.alias("kind"),
        code.alias("code"),
        F.when(as_kind.isin("allergy", "medication"), _pick(FAMILIES, nth)).alias("family"),
        F.when(as_kind == "low_confidence", F.col("event_id").cast("string")).alias("item_id"),
        F.when(as_kind == "vital", F.col("value") + 90).otherwise(F.col("value")).alias("value"),
        ((kind == "click") & (F.col("value") < 10)).alias("negated"),
    )


def _list(values: list[str], n: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({n}) % {len(values)} + 1]"


_other = _list(OTHERS, "k")
_kind = "case event_type " + " ".join(f"when '{e}' then '{v}'" for e, v in KINDS.items()) + f" else {_other} end"
_code = "case " + " ".join(f"when event_type = '{e}' then {_list(v, 'k')}" for e, v in CODES.items()) + f" when {_other} = 'test' then {_list(TESTS, 'k // 8')} when {_other} = 'lab' then {_list(LABS, 'k // 8')} when {_other} = 'persistent' then {_list(SYMPTOMS, 'k // 8')} when {_other} = 'worsening' then 'bp' when {_other} = 'emergency' then 'flag' end"
CODED = f"""ek as (select *, json_extract_string(props, '$.k')::int k from events),
  rf as (select user_id || '-' || floor((epoch(ts) - epoch(timestamp '2024-01-01')) / (7 * {DAY}))::bigint visit_id, event_id fact_id, {_kind} kind, {_code} code, case when {_kind} in ('allergy', 'medication') then {_list(FAMILIES, 'k // 8')} end as family,
    case when {_kind} = 'low_confidence' then event_id::varchar end item_id, case when {_kind} = 'vital' then value + 90 else value end as value, event_type = 'click' and value < 10 negated from ek)"""


def _matches(c: o.Condition) -> str:
    """Facts f that a condition is about."""
    kind, code = c.term.split("|")
    out = f"f.visit_id = v.visit_id and f.kind = '{kind}'"
    if code.startswith("family:"):
        out += f" and f.family = '{code[7:]}'"
    elif code != "*":
        out += f" and f.code = '{code}'"
    if c.op:
        out += f" and f.value {c.op} {c.bound}"
    if c.negated is not None:
        out += f" and f.negated = {str(c.negated).lower()}"
    if c.bind:
        out += f" and f.{c.bind} = v.dedupe"
    return out


def _fired_sql() -> str:
    """Each rule's clauses one by one, as what exists and what doesn't."""
    out = []
    for r in o.BASE_RULES:
        mine = [c for c in o.BASE_CONDITIONS if c.rule_id == r.rule_id]
        bind = next((c.bind for c in mine if c.bind), None)
        base = f"select distinct visit_id, {bind} dedupe from rf where {bind} is not null" if bind else "select distinct visit_id, '' dedupe from rf"
        tests = []
        for n in sorted({c.clause for c in mine}):
            any_of = " or ".join(f"exists (select 1 from rf f where {_matches(c)})" for c in mine if c.clause == n)
            tests.append(f"not ({any_of})" if any(c.absent for c in mine if c.clause == n) else f"({any_of})")
        shown = " or ".join(f"({_matches(c)})" for c in mine if c.shown and not c.absent)
        evidence = f"(select coalesce(list(f.fact_id order by f.fact_id), []) from rf f where {shown})"
        said = f"(select coalesce(list_sort(list(distinct f.kind || ':' || coalesce(f.code, f.family)) filter (where coalesce(f.code, f.family) is not null)), []) from rf f where {shown})"
        fixed = "[" + ", ".join(f"'{x}'" for x in r.tests) + "]::varchar[]"
        required = o.REQUIRED.get(r.condition, []) if r.from_graph else []
        graph = ", ".join(f"case when not exists (select 1 from rf f where f.visit_id = v.visit_id and f.kind = 'test' and f.code = '{x}') then '{x}' end" for x in sorted(required))
        missing = f"list_filter([{graph}], lambda x: x is not null)" if required else fixed
        condition = f"'{r.condition}'" if r.condition else "null"
        whole = f"select visit_id, '{r.rule_id}' rule_id, dedupe, '{r.severity}' severity, {condition} as condition, {evidence} evidence, {said} said, {missing} missing from ({base}) v where {' and '.join(tests)}"
        out.append(f"select * from ({whole}) where len(missing) > 0" if r.only_missing else whole)
    return "fired as (" + " union all ".join(out) + ")"


FIRED = f"{CODED}, {_fired_sql()}"


@query("rul_06", f"with {FIRED} select visit_id, rule_id, dedupe, severity, condition, missing from fired")
def rul_06(t: Tables) -> DataFrame:
    return o.fire(coded_facts(t), *o.base_rules(t.spark)).select("visit_id", "rule_id", "dedupe", "severity", "condition", "missing")


@query("rul_04", f"with {FIRED} select visit_id, rule_id, dedupe, evidence, list_append(said, case when len(missing) > 0 then rule_id || ' -> ' || array_to_string(missing, ', ') else rule_id end) chain from fired")
def rul_04(t: Tables) -> DataFrame:
    return o.fire(coded_facts(t), *o.base_rules(t.spark)).select("visit_id", "rule_id", "dedupe", "evidence", "chain")


# Codes that events stand for where thresholds and sets of signs are looked at.
NUMBERS = ["maternal_age", "parity", "ga_weeks", "trimester", "proteinuria_grade", "hemoglobin_g_dl", "respiratory_rate", "cervical_dilation_cm", "diastolic_bp", "fetal_heart_rate_bpm", "second_stage_duration_hours", "postpartum_hours_since_birth", "active_stage_duration_hours", "bp_readings_count", "temp"]
SAID = sorted({s for _, _, every in o.SIGNS for s in every} | {"fever", "unable_to_stand", "irregular_contractions", "primipara", "chest_pain", "temperature_gt_38"})
SCALE = [5, 20, 2.5, 30, 20, 5, 2, 8, 1, 0.5, 30, 5, 5, 25, 2.5]


def measured_facts(t: Tables) -> DataFrame:
    k, number = F.get_json_object("props", "$.k").cast("int"), F.col("event_type").isin("view", "error")
    scaled = F.round(F.col("value") / F.get(F.array(*[F.lit(float(x)) for x in SCALE]), (k % len(NUMBERS)).cast("int")), 1)
    return coded_facts(t).select("visit_id", "fact_id").join(t.events.select(F.col("event_id").alias("fact_id"), F.when(number, _pick(NUMBERS, k)).otherwise(_pick(SAID, F.col("event_id") % 997)).alias("code"), F.when(number, scaled).alias("value"), (~number & (F.col("value") < 3)).alias("negated")), "fact_id")


def _band_sql(code: str, source: str, low: float | None, low_open: bool, high: float | None, high_open: bool) -> str:
    test = [f"value {'>' if low_open else '>='} {low}"] * (low is not None) + [f"value {'<' if high_open else '<='} {high}"] * (high is not None)
    return f"select visit_id, '{code}' code, {' and '.join(test)} holds from last where code = '{source}'"


_scale = "[" + ", ".join(map(str, SCALE)) + "]"
_number = "event_type in ('view', 'error')"
_cervix, _hours = "(select value from last l where l.visit_id = v.visit_id and l.code = 'cervical_dilation_cm')", "(select value from last l where l.visit_id = v.visit_id and l.code = 'active_stage_duration_hours')"
_temp = "(select max(value) from mf l where l.visit_id = v.visit_id and l.code = 'temp')"
_signs = " union all ".join(f"select visit_id, '{c}', true from v where len(list_intersect(codes, [{', '.join(repr(s) for s in every)}])) >= {least}" for c, least, every in o.SIGNS)
MEASURED = f"""{CODED}, mf as (select visit_id, fact_id, case when {_number} then {_list(NUMBERS, 'k')} else {_list(SAID, 'event_id % 997')} end code,
    case when {_number} then round(e.value / {_scale}[k % {len(NUMBERS)} + 1], 1) end as value, not {_number} and e.value < 3 negated from rf join ek e on event_id = fact_id),
  last as (select visit_id, code, arg_max(value, fact_id) as value from mf where value is not null group by 1, 2), v as (select visit_id, coalesce(list(distinct code) filter (where not negated), []) codes from mf group by 1),
  d as ({" union all ".join(_band_sql(*b) for b in o.BANDS)} union all {_signs}
    union all select visit_id, 'bp_readings_at_least_2', greatest(count(*) filter (where code = 'diastolic_bp' and value >= 90), coalesce(floor(arg_max(value, fact_id) filter (where code = 'bp_readings_count' and value is not null)), 0)) >= 2 from mf group by 1
    union all select visit_id, 'danger_fever_weakness_cluster', true from v where ('fever' in codes or {_temp} >= 38) and 'unable_to_stand' in codes
    union all select visit_id, 'labour_stage_latent', true from v where {_cervix} < 5 or ({_cervix} <= 5 and 'irregular_contractions' in codes)
    union all select visit_id, 'active_stage_prolonged', true from v where {_hours} > case when 'primipara' in codes then 12 else 10 end
    union all select visit_id, 'pneumonia_sign_count_ge_2', true from v where (coalesce({_temp} > 38, false) or 'temperature_gt_38' in codes)::int + ('shortness_of_breath' in codes)::int + ('chest_pain' in codes)::int >= 2)"""


@query("agg_30", f"with {MEASURED} select visit_id, code, bool_or(holds) holds from d where holds is not null group by 1, 2")
def agg_30(t: Tables) -> DataFrame:
    return o.derived_facts(measured_facts(t))
