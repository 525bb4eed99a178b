"""Queries of full extraction over documents and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.operators import extraction as o
from visitloom.plans.bindings import SEGMENTS, segments
from visitloom.plans.registry import Tables, query
from visitloom.plans.updates import ENDS, SAYS, _level_sql, _said_sql

# One surface for each kind, so that no claim of a kind stands in another's way.
TERMS = [("symptom", "A", "the"), ("procedure", "follow_up_visit", "and"), ("condition", "puerperal_infection", "with"), ("lab", "L", "in"), ("drug", "D", "for")]
SUSPECTED = o.Pattern("condition", "puerperal_infection", "with the", status="suspected")
LEVELS = {"high": ["the"], "low": ["in"], "normal": ["re"]}
_edge = "[^\\p{L}\\p{N}]"


def _lexicon(t: Tables, terms: list[tuple[str, str, str]]) -> DataFrame:
    return t.spark.createDataFrame(terms, "kind string, code string, surface string")


def _first_sql(table: str, terms: list[tuple[str, str, str]]) -> str:
    """The first place of each term as whole words in rows (id, label, text)."""
    return " union all ".join(f"select id, label, text, '{k}' kind, '{c}' code, length(regexp_extract(lower(text), '(?s)^(|.*?{_edge}){s}(?:{_edge}|$)', 1)) p, {len(s)} n from {table} where regexp_matches(lower(text), '(^|{_edge}){s}({_edge}|$)')" for k, c, s in terms)


EXTRACTED = f"""docs as (select doc_id id, case when doc_id % 2 = 0 then 'plan' else 'note' end as label, coalesce(text, '') as text from documents), f as ({_first_sql("docs", TERMS)}),
  m as (select *, p + n e, regexp_replace(text, '(\\d)[.,](\\d)', '\\10\\2', 'g') x from f),
  b as (select *, length(regexp_extract(substr(x, 1, p), '(?is)^.*(?:{ENDS})')) st, e + length(regexp_extract(substr(x, e + 1), '(?is)^(.*?)(?:{ENDS}|$)', 1)) en from m),
  c as (select *, substr(text, st + 1, p - st) bf, substr(text, greatest(st, p - 40) + 1, p - greatest(st, p - 40)) nb, substr(text, e + 1, least(en - e, 25)) af, substr(text, st + 1, en - st) wh, greatest(st, p - 30) f, least(en, e + 30) u,
    nullif(strpos(lower(text), ' on '), 0) - 1 cond from b),
  s as (select *, {_said_sql("bf", "nb", "af", "wh")} said, lower(substr(text, f + 1, u - f)) nr, contains(substr(lower(text), 1, coalesce(cond, length(text))::bigint), 'to ') sched from c),
  l as (select *, case when {_level_sql("the")} then 'high' when {_level_sql("in")} then 'low' when {_level_sql("re")} then 'normal' end q, try_cast(replace(nullif(regexp_extract(substr(text, e + 1, u - e), '(\\d+(?:[.,]\\d+)?)', 1), ''), ',', '.') as double) v from s where kind = 'lab'),
  sus as (select id, strpos(text, 'with the') - 1 p from docs where contains(text, 'with the')),
  every as (
    select id, kind, code, p, e, case when kind = 'procedure' and (label = 'plan' and said = 'present' or code = 'follow_up_visit' and said = 'hypothetical' and coalesce(cond > e, false) and sched) then 'planned' else said end as assertion, null status, null::double as value from s where kind in ('symptom', 'procedure') or kind = 'condition' and id not in (select id from sus)
    union all select id, 'condition', 'puerperal_infection', p, p + 8, 'present', 'suspected', null from sus
    union all select id, 'medication', code, p, e, said, null, null from s where kind = 'drug'
    union all select id, kind, code, p, e, case when q is not null or v is not null then 'present' else said end, q, v from l union all select id, 'test', code || '_test', p, e, 'present', null, null from l)"""


@query("ext_10", f"with {EXTRACTED} select id, kind, code, p::int \"begin\", e::int \"end\", assertion, status, value from every")
def ext_10(t: Tables) -> DataFrame:
    texts = t.documents.select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 2 == 0, "plan").otherwise("note").alias("label"))
    out = o.extract(texts, _lexicon(t, TERMS), [SUSPECTED], cues=SAYS, levels=LEVELS, conditionals=(" on ",), scheduled=("to ",))
    return out.select("id", "kind", "code", "begin", "end", "assertion", "status", "value")


@query("ext_09", f"""with d as (select doc_id id, case when doc_id % 3 = 0 then 'allergy' when doc_id % 3 = 1 then 'treatment' else 'note' end as label, coalesce(text, '') as text from documents),
  k as (select id, label, regexp_matches(lower(text), '(^|{_edge})that({_edge}|$)') known, text from d), w as (select id, label, known, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-]{{3,}}'))) surface from k where label <> 'note'),
  u as (select id, label, surface, count(*) - case when surface = 'that' and any_value(known) then 1 else 0 end n from w where surface not in ({", ".join(f"'{x}'" for x in sorted(o.NO_DRUGS - {"that"}))}) group by 1, 2, 3),
  x as (select id, case label when 'allergy' then 'allergy' else 'medication' end kind, 'unknown_drug' code, surface, n from u where surface <> 'that')
  select id, kind, code, surface, n::bigint n from x union all select id, case label when 'allergy' then 'allergy' else 'medication' end, 'D', 'that', 1 from k where known""")
def ext_09(t: Tables) -> DataFrame:
    label = F.when(F.col("doc_id") % 3 == 0, "allergy").when(F.col("doc_id") % 3 == 1, "treatment").otherwise("note")
    found = o.drug_mentions(t.documents.select(F.col("doc_id").alias("id"), "text", label.alias("label")), _lexicon(t, [("drug", "D", "that")]))
    return found.groupBy("id", "kind", "code", F.lower("surface").alias("surface")).agg(F.count("*").alias("n"))


# A decimal claims its place before a plain number; numbers up to 25 are said in tens; words behind numbers multiply them.
NUMBERS = [o.Pattern("fact", "decimal", r"([0-9]+)\.([0-9]+)", "unit", group="n"), o.Pattern("fact", "plain", "([0-9]+)", "mmHg", group="n", short=True), o.Pattern("fact", "times", "([0-9]+) (?P<per>the|of|[a-z]+)", "month", scale={"the": 12.0, "of": 24.0})]


@query("ext_07", """with d as (select doc_id id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[0-9]+\\.[0-9]+', 'x') r from documents),
  f as (select id, 'decimal' code, try_cast(regexp_extract(text, '([0-9]+)\\.([0-9]+)', 1) as double) as value, try_cast(regexp_extract(text, '([0-9]+)\\.([0-9]+)', 2) as double) value2, 'unit' unit from d
    union all select id, 'plain', case when v <= 25 then v * 10 else v end, null, 'mmHg' from (select id, try_cast(regexp_extract(r, '([0-9]+)', 1) as double) v from d)
    union all select id, 'times', try_cast(regexp_extract(text, '([0-9]+) (the|of|[a-z]+)', 1) as double) * case regexp_extract(text, '([0-9]+) (the|of|[a-z]+)', 2) when 'the' then 12 when 'of' then 24 else 1 end, null, 'month' from d)
  select * from f where value is not null""")
def ext_07(t: Tables) -> DataFrame:
    return o.numeric_facts(t.documents.select(F.col("doc_id").alias("id"), "text"), NUMBERS).select("id", "code", "value", "value2", "unit")


WORDS = [("symptom", "A", "the"), ("nutrition", "B", "of")]


@query("upd_06", f"with {SEGMENTS}, now as (select job_id || '-' || order_index id, '' as label, case when order_index % 2 = 0 then 'many other of us' else text end as text from segments), f as ({_first_sql('now', WORDS)}) select id, kind, code, p::int \"begin\", (p + n)::int \"end\" from f")
def upd_06(t: Tables) -> DataFrame:
    """Every second turn is edited; what was found in it goes, what it says now comes."""
    rows = segments(t).select(F.concat_ws("-", F.col("job_id").cast("string"), F.col("order_index").cast("string")).alias("id"), "text", F.lit("").alias("label"), "order_index")
    before = o.extract(rows, _lexicon(t, WORDS), [])
    edited = rows.where("order_index % 2 = 0").withColumn("text", F.lit("many other of us"))
    return o.refresh(before, edited, _lexicon(t, WORDS), []).select("id", "kind", "code", "begin", "end")
