"""What a visit's stored links, words and record say of it: facts, stage, contradictions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of stored links and the facts they become, other names of codes, what suspected findings are called,
# values that are facts of their own, readings that imply a test.
KINDS = {"symptom": "symptom", "condition": "diagnosis", "test": "test_done", "lab": "lab", "medication": "medication", "allergy": "allergy", "vital": "vital", "procedure": "test_done", "nutrition": "nutrition", "clinical": "clinical", "history": "clinical", "screening": "clinical"}
ALIASES = {"blood_pressure": "bp", "blood-pressure": "bp", "bloodPressure": "bp", "temperature": "temp"}
SUSPECTED = {("diagnosis", "puerperal_infection"): "suspected_puerperal_infection", (None, "water_breaking"): "suspected_rupture_of_membranes"}
COPIES = {("lab", "hemoglobin"): "hemoglobin_g_dl"}
IMPLIED = {("vital", "bp"): "bp_measurement"}
# Stages that a record may name, and what follows from them.
PHASES = ("second", "third", "newborn", "postpartum", "discharge")
OF_PHASE = {"discharge": ("discharge", "predischarge"), "postpartum": ("postpartum", "postpartum_follow_up"), "newborn": ("newborn",), "third": ("third_stage",), "second": ("delivery", "birth", "second_stage")}
AFTER_BIRTH = OF_PHASE["postpartum"] + OF_PHASE["discharge"]
IN_LABOUR = ("labour", "labor", "intrapartum", "active_labour", "latent_labour")


def _mapped(code: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return known[code]


def facts_from_links(items: DataFrame) -> DataFrame:
    """item_id, kind, code, negated, value, status of items (item_id, label, is_urgent, links).

    links: an array of kind, code, assertion, status, value. Links of other kinds, and those neither present (also where
    none is said) nor absent, are left out. A suspected finding is a clinical fact under a name of its own; a value that is a fact of its own
    comes once more; a reading implies its test; an urgent item, or one under the label emergency of which nothing is
    said, is an emergency. All is one array a row: nothing is shuffled.
    """
    none = F.lit(None)

    def fact(kind, code, negated, value=none, status=none) -> Column:
        named = (("kind", kind, "string"), ("code", code, "string"), ("negated", negated, "boolean"), ("value", value, "double"), ("status", status, "string"))
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(t).alias(n) for n, v, t in named])

    def is_any(kind: Column, code: Column, keys) -> Column:
        return reduce(or_, [(F.lit(True) if k is None else kind == k) & (code == c) for k, c in keys], F.lit(False))

    def facts(link: Column) -> Column:
        kind, code = _mapped(link["kind"], KINDS), F.coalesce(_mapped(link["code"], ALIASES), link["code"], F.lit(""))
        said = F.coalesce(link["assertion"], F.lit("present"))
        suspected = (link["status"] == "suspected") & is_any(kind, code, SUSPECTED)
        name = F.coalesce(*[F.when(is_any(kind, code, [key]), F.lit(n)) for key, n in SUSPECTED.items()])
        own = fact(kind, code, said == "absent", link["value"], link["status"])
        copies = [F.when((said == "present") & link["value"].isNotNull() & is_any(kind, code, [key]), fact("clinical", n, False, link["value"])) for key, n in COPIES.items()]
        implied = [F.when((said == "present") & is_any(kind, code, [key]), fact("test_done", n, False)) for key, n in IMPLIED.items()]
        whole = F.array_compact(F.array(own, *copies, *implied))
        nothing = F.slice(F.array(own), 1, 0)
        return F.when(kind.isNull() | ~said.isin("present", "absent"), nothing).when(F.coalesce(suspected, F.lit(False)), F.array(fact("clinical", name, False, none, "suspected"))).otherwise(whole)

    urgent = F.coalesce(F.col("is_urgent"), F.col("label") == "emergency", F.lit(False))
    flag = F.filter(F.array(F.when(urgent, fact("emergency", "emergency", False))), lambda x: x.isNotNull())
    every = F.concat(F.coalesce(F.flatten(F.transform("links", facts)), F.slice(F.array(fact("", "", False)), 1, 0)), flag)
    return items.select("item_id", F.inline(every))


def visit_stage(visits: DataFrame, markers: dict[str, list[str]], cervix: str, pregnancy_labels: list[str]) -> DataFrame:
    """visit_id, delivery_phase, labour_stage, labour, delivery, postpartum, pregnant of visits.

    visits: visit_id, text (all that was said), labels, and what the record has: stage, delivery_phase, labour_stage and
    effective_status, each null where it says nothing. markers: words for each of PHASES but second's own number, and for
    labour, active, latent and pregnant; cervix: a regular expression whose group is the dilation in cm. The record comes
    first, then the most advanced stage that a word tells. Labour, delivery and what follows switch pregnancy off, and
    the effective status has the last word.
    """
    stage, text = F.lower(F.trim(F.coalesce("stage", F.lit("")))), F.coalesce("text", F.lit(""))
    status = F.lower(F.coalesce("effective_status", F.lit("")))
    cm = F.nullif(F.regexp_extract(text, cervix, 1), F.lit("")).cast("double")

    def told(kind: str) -> Column:
        return reduce(or_, [F.contains(text, F.lit(w)) for w in markers.get(kind, [])], F.lit(False))

    def labelled(names: list[str]) -> Column:
        return F.coalesce(F.arrays_overlap("labels", F.array(*map(F.lit, names)).cast("array<string>")), F.lit(False))

    after = told("postpartum") | labelled(["postpartum"])
    seen = {"discharge": told("discharge"), "postpartum": after, "newborn": told("newborn"), "third": told("third"), "second": told("second") | F.coalesce(cm >= 10, F.lit(False))}
    phase = F.coalesce(F.when(F.col("delivery_phase").isin(*PHASES), F.col("delivery_phase")), *[F.when(stage.isin(*OF_PHASE[p]) | seen[p], F.lit(p)) for p in OF_PHASE])
    rows = visits.select("visit_id", stage.alias("s"), status.alias("e"), F.lower(F.trim(F.coalesce("labour_stage", F.lit("")))).alias("l"), phase.alias("phase"), cm.alias("cm"), after.alias("after"), (told("labour") | cm.isNotNull()).alias("in_labour"), told("active").alias("active"), told("latent").alias("latent"), (told("pregnant") | labelled(pregnancy_labels)).alias("hint"))
    s, e = F.col("s"), F.col("e")
    delivery = s.isin(*[x for names in OF_PHASE.values() for x in names]) | F.col("phase").isNotNull()
    rows = rows.withColumns({"delivery": delivery, "post": s.isin(*AFTER_BIRTH) | F.col("after") | F.coalesce(F.col("phase").isin("postpartum", "discharge"), F.lit(False)), "labour": s.isin(*IN_LABOUR) | (F.col("in_labour") & F.col("phase").isNull())})
    by_cm = F.when(F.col("cm") >= 10, "second").when(F.col("cm") >= 5, "active").when(F.col("cm").isNotNull(), "latent")
    part = F.when(F.col("l").isin("latent", "active", "second"), F.col("l")).when(s == "latent_labour", "latent").when(s == "active_labour", "active").when(F.col("labour"), F.when(F.col("active"), "active").when(F.col("latent"), "latent").otherwise(by_cm))
    busy = F.col("labour") | F.col("delivery") | F.col("post")
    pregnant = F.when(e.isin("postpartum", "unknown", "not_pregnant"), False).when((e == "pregnant") & ~busy, True).otherwise((s == "pregnancy") | (F.col("hint") & ~busy))
    return rows.select("visit_id", F.col("phase").alias("delivery_phase"), part.alias("labour_stage"), "labour", "delivery", ((e == "postpartum") | F.col("post")).alias("postpartum"), pregnant.alias("pregnant"))


def consistency_warnings(visits: DataFrame, age: str, years: str) -> DataFrame:
    """visit_id, warnings of visits (visit_id, text, record_age, weeks_before, weeks), those in this order that hold.

    age and years: regular expressions whose group is the age said, and how many years ago an earlier birth is said to
    have been. birth_before_age: so many years or more; age_differs: by more than one from the record's; week_goes_back:
    the week is more than one below the one before. What isn't said contradicts nothing.
    """

    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), pattern, 1), F.lit("")).cast("int")

    said = visits.select("visit_id", number(age).alias("age"), number(years).alias("years"), "record_age", "weeks_before", "weeks")
    tests = (("birth_before_age", F.col("years") >= F.col("age")), ("age_differs", F.abs(F.col("record_age") - F.col("age")) > 1), ("week_goes_back", F.col("weeks_before") > F.col("weeks") + 1))
    return said.select("visit_id", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests])).alias("warnings"))
