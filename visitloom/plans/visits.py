"""Queries of what visits say of themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.operators import visits as o
from visitloom.plans.bindings import JOBS, SEGMENTS, jobs, segments
from visitloom.plans.registry import Tables, query

LINK_KINDS, LINK_CODES = ["symptom", "condition", "test", "lab", "vital", "procedure", "other"], ["blood_pressure", "temperature", "puerperal_infection", "water_breaking", "hemoglobin", "bp", "x"]
SAID = ["present", "absent", "planned", None]


def _pick(values: list[str | None], n) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def linked_items(t: Tables) -> DataFrame:
    """A patient's day is an item, its events are links."""
    k = F.get_json_object("props", "$.k").cast("int")
    link = F.struct("event_id", _pick(LINK_KINDS, F.col("event_id")).alias("kind"), _pick(LINK_CODES, k).alias("code"), _pick(SAID, F.col("event_id") + k).alias("assertion"), F.when(k % 2 == 0, "suspected").alias("status"), F.when(k % 5 > 0, F.col("value")).alias("value"))
    item = F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    user = F.col("user_id")
    return t.events.groupBy(item.alias("item_id"), user).agg(F.array_sort(F.collect_list(link)).alias("links")).select("item_id", F.when(user % 2 == 0, "emergency").otherwise("note").alias("label"), F.when(user % 3 == 1, True).when(user % 3 == 2, False).alias("is_urgent"), "links")


def _list(values: list[str | None], n: str) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + f"][({n}) % {len(values)} + 1]"


_kinds = "case kind " + " ".join(f"when '{a}' then '{b}'" for a, b in o.KINDS.items()) + " end"
_codes = "case code " + " ".join(f"when '{a}' then '{b}'" for a, b in o.ALIASES.items()) + " else code end"


@query("ext_12", f"""with e as (select *, json_extract_string(props, '$.k')::int k, user_id || '-' || ts::date item_id from events), l as (select item_id, {_list(LINK_KINDS, 'event_id')} kind, {_list(LINK_CODES, 'k')} code, coalesce({_list(SAID, 'event_id + k')}, 'present') said, case when k % 2 = 0 then 'suspected' end status, case when k % 5 > 0 then value end as value from e),
  m as (select item_id, {_kinds} kind, {_codes} code, said, status, value from l), f as (select *, coalesce(status = 'suspected' and (kind = 'diagnosis' and code = 'puerperal_infection' or code = 'water_breaking'), false) sus from m where kind is not null and said in ('present', 'absent'))
  select item_id, kind, code, said = 'absent' negated, value, status from f where not sus
  union all select item_id, 'clinical', case code when 'water_breaking' then 'suspected_rupture_of_membranes' else 'suspected_puerperal_infection' end, false, null, 'suspected' from f where sus
  union all select item_id, 'clinical', 'hemoglobin_g_dl', false, value, null from f where kind = 'lab' and code = 'hemoglobin' and said = 'present' and value is not null
  union all select item_id, 'test_done', 'bp_measurement', false, null, null from f where kind = 'vital' and code = 'bp' and said = 'present'
  union all select distinct item_id, 'emergency', 'emergency', false, null::double, null from e where user_id % 3 = 1 or (user_id % 3 = 0 and user_id % 2 = 0)""")
def ext_12(t: Tables) -> DataFrame:
    return o.facts_from_links(linked_items(t))


MARKERS = {"discharge": ["und die"], "postpartum": ["de la"], "newborn": ["in the"], "third": ["que la"], "second": ["to the"], "labour": ["of the", "und der"], "active": ["and "], "latent": ["that"], "pregnant": ["the", "der"]}
STAGES = ["", "pregnancy", "labour", "latent_labour", "Birth ", "third_stage", "postpartum", "discharge", "x", None, None, None, None]
DELIVERY, LABOUR, STATUS = [None, None, None, None, "third", "odd"], [None, None, "active", "odd"], [None, None, None, "postpartum", "pregnant", "unknown"]


def _told(kind: str) -> str:
    return "(" + " or ".join(f"contains(text, '{w}')" for w in MARKERS[kind]) + ")"


def _in(names: tuple[str, ...]) -> str:
    return "s in (" + ", ".join(f"'{n}'" for n in names) + ")"


_every = tuple(x for names in o.OF_PHASE.values() for x in names)
STAGED = f"""{SEGMENTS}, j as (select job_id visit_id, string_agg(text, ' ' order by order_index) || case when job_id % 5 = 0 then ' ' || job_id % 12 || ' cm' else '' end as text, bool_or(speaker = 'user') asked from segments where job_id is not null group by 1, job_id),
  r as (select visit_id, text, lower(trim(coalesce({_list(STAGES, 'visit_id')}, ''))) s, {_list(DELIVERY, 'visit_id')} dp, coalesce({_list(LABOUR, 'visit_id')}, '') l, coalesce({_list(STATUS, 'visit_id')}, '') e, try_cast(nullif(regexp_extract(text, '(\\d+) cm', 1), '') as double) cm from j),
  p as (select *, case when dp in {o.PHASES} then dp when {_in(o.OF_PHASE['discharge'])} or {_told('discharge')} then 'discharge' when {_in(o.OF_PHASE['postpartum'])} or {_told('postpartum')} then 'postpartum' when s = 'newborn' or {_told('newborn')} then 'newborn' when s = 'third_stage' or {_told('third')} then 'third'
    when {_in(o.OF_PHASE['second'])} or {_told('second')} or coalesce(cm >= 10, false) then 'second' end phase from r),
  q as (select *, {_in(_every)} or phase is not null delivery, {_in(o.AFTER_BIRTH)} or {_told('postpartum')} or coalesce(phase in ('postpartum', 'discharge'), false) post, {_in(o.IN_LABOUR)} or (({_told('labour')} or cm is not null) and phase is null) labour from p)"""


@query("agg_34", f"""with {STAGED} select visit_id, phase delivery_phase, case when l in ('latent', 'active', 'second') then l when s = 'latent_labour' then 'latent' when s = 'active_labour' then 'active' when labour then case when {_told('active')} then 'active' when {_told('latent')} then 'latent' when cm >= 10 then 'second' when cm >= 5 then 'active' when cm is not null then 'latent' end end labour_stage,
  labour, delivery, e = 'postpartum' or post postpartum, case when e in ('postpartum', 'unknown', 'not_pregnant') then false when e = 'pregnant' and not (labour or delivery or post) then true else s = 'pregnancy' or ({_told('pregnant')} and not (labour or delivery or post)) end pregnant from q""")
def agg_34(t: Tables) -> DataFrame:
    """Conversations as visits; what their record says goes by their number."""
    said = segments(t).where("job_id is not null").groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "text"))), lambda x: x["text"]), " ").alias("text"))
    n = F.col("job_id")
    text = F.concat("text", F.when(n % 5 == 0, F.concat(F.lit(" "), (n % 12).cast("string"), F.lit(" cm"))).otherwise(""))
    visits = said.select(n.alias("visit_id"), text.alias("text"), F.array().cast("array<string>").alias("labels"), _pick(STAGES, n).alias("stage"), _pick(DELIVERY, n).alias("delivery_phase"), _pick(LABOUR, n).alias("labour_stage"), _pick(STATUS, n).alias("effective_status"))
    return o.visit_stage(visits, MARKERS, r"(\d+) cm", ["pregnancy"])


SPOKEN = """'seen ' || patient_id || case when job_id % 3 > 0 then ', age ' || patient_id % 60 else '' end || case when job_id % 4 > 0 then ', birth ' || job_id % 45 || ' years ago' else '' end"""


@query("agg_36", f"""with {JOBS}, v as (select job_id visit_id, {SPOKEN} as text, case when job_id % 5 > 0 then (patient_id + job_id % 4) % 60 end record_age, case when patient_id % 7 > 0 then patient_id % 40 end before, (patient_id + job_id % 5) % 40 now from jobs),
  n as (select *, try_cast(regexp_extract(text, 'age (\\d+)', 1) as int) age, try_cast(regexp_extract(text, 'birth (\\d+) years', 1) as int) yrs from v)
  select visit_id, list_filter([case when yrs >= age then 'birth_before_age' end, case when abs(record_age - age) > 1 then 'age_differs' end, case when before > now + 1 then 'week_goes_back' end], lambda x: x is not null) warnings from n""")
def agg_36(t: Tables) -> DataFrame:
    n, p = F.col("job_id"), F.col("patient_id")
    text = F.concat(F.lit("seen "), p.cast("string"), F.when(n % 3 > 0, F.concat(F.lit(", age "), (p % 60).cast("string"))).otherwise(""), F.when(n % 4 > 0, F.concat(F.lit(", birth "), (n % 45).cast("string"), F.lit(" years ago"))).otherwise(""))
    visits = jobs(t).select(n.alias("visit_id"), text.alias("text"), F.when(n % 5 > 0, (p + n % 4) % 60).alias("record_age"), F.when(p % 7 > 0, p % 40).alias("weeks_before"), ((p + n % 5) % 40).alias("weeks"))
    return o.consistency_warnings(visits, r"age (\d+)", r"birth (\d+) years")
