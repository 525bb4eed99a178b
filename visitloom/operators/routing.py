"""Sections and urgency of report items, from their labels, wording and linked findings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of links that are findings, and codes of context links.
CLINICAL = ["symptom", "condition", "vital", "lab", "clinical"]
PLAN_CODES = ["plan_continuation", "contingency_condition", "contingency_action"]
EXAM_CODES, TIMING_CODES = ["exam_finding", "cervical_dilation_cm"], ["postpartum_days", "postpartum_weeks"]
#: Pressures from which a reading is urgent.
SEVERE = (160, 110)


def _any(test) -> Column:
    return F.exists(F.coalesce("links", F.array()), test)


def _clinical(x: Column) -> Column:
    return x["kind"].isin(CLINICAL)


def _present(*kinds: str) -> Column:
    return _any(lambda x: x["kind"].isin(list(kinds)) & (x["assertion"] == "present"))


def route_item(items: DataFrame, sections: dict[str, str], wording: dict[str, Column]) -> DataFrame:
    """items (labels, links of kind, code, assertion, value, value2) with section and the sections it is also of.

    The first that holds: plan for a context of plan or contingency, for findings that are all hypothetical, or for plan
    wording; objective for an exam's finding; subjective for an emergency label whose findings are all denied, for a
    present symptom that the patient reports or dates from birth without a present or suspected condition, and for
    movement said to be normal in a follow-up. Else the label's section that comes first of plan, assessment, objective
    and subjective. wording: conditions plan, exam, reported, movement over the columns of items. Null links: none.
    """
    order = ["plan", "assessment", "objective", "subjective"]
    known = F.create_map(*[F.lit(x) for pair in sections.items() for x in pair])
    own = F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.coalesce(known[x], F.lit("subjective")))
    base = F.filter(F.array(*map(F.lit, order)), lambda s: F.array_contains(own, s))
    by_label = F.coalesce(F.get(base, F.lit(0)), F.lit("subjective"))

    def coded(codes: list[str]) -> Column:
        return _any(lambda x: x["code"].isin(codes))

    says = {k: F.coalesce(v, F.lit(False)) for k, v in wording.items()}
    planned = coded(PLAN_CODES) | (_any(_clinical) & ~_any(lambda x: _clinical(x) & (x["assertion"] != "hypothetical"))) | says["plan"]
    exam = says["exam"] | coded(EXAM_CODES)
    denied = F.array_contains("labels", "emergency") & _any(_clinical) & ~_present(*CLINICAL)
    suspected = _any(lambda x: (x["kind"] == "condition") & x["assertion"].isin("present", "suspected"))
    told = _present("symptom") & ~suspected & (says["reported"] | coded(TIMING_CODES))
    moves = F.array_contains("labels", "follow_up") & says["movement"]
    section = F.when(planned, "plan").when(exam, "objective").when(F.coalesce(denied, F.lit(False)) | told | F.coalesce(moves, F.lit(False)), "subjective").otherwise(by_label)
    routed = items.withColumn("_base", base).withColumn("section", section)
    return routed.withColumn("also", F.array_except("_base", F.array("section"))).drop("_base")


def is_urgent(wording: Column) -> Column:
    """Whether an item (labels, links) is urgent: an emergency label with a present finding or without any finding, a
    present pressure (code bp: value over value2) from SEVERE on, or urgent plan wording."""
    emergency = F.coalesce(F.array_contains("labels", "emergency"), F.lit(False)) & (~_any(_clinical) | _present(*CLINICAL))
    severe = _any(lambda x: (x["code"] == "bp") & (x["assertion"] == "present") & reduce(or_, [F.coalesce(x[v] >= limit, F.lit(False)) for v, limit in zip(("value", "value2"), SEVERE, strict=True)]))
    return emergency | severe | F.coalesce(wording, F.lit(False))
