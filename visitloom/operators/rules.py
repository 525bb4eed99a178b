"""Rules over the facts of visits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present_codes(facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("negated")).groupBy("visit_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def rule_evidence(fired: DataFrame, facts: DataFrame) -> DataFrame:
    """Of each fired rule (visit_id, rule_id, codes): the ids of the visit's facts with one of its codes."""
    listed = fired.select("visit_id", "rule_id", F.explode("codes").alias("code"))
    return facts.select("visit_id", "code", "fact_id").join(listed, ["visit_id", "code"]).groupBy("visit_id", "rule_id").agg(F.array_sort(F.collect_list("fact_id")).alias("evidence"))


def has(code: str, test: Column | None = None) -> Column:
    """An aggregate: whether any of a visit's facts has the code and passes the test."""
    hit = (F.col("code") == code) & (F.lit(True) if test is None else test)
    return F.coalesce(F.bool_or(hit), F.lit(False))


def all_of(facts: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Visits of which every condition (an aggregate) holds."""
    per = facts.groupBy("visit_id").agg(*[c.alias(name) for name, c in conditions.items()])
    return per.where(reduce(lambda a, b: a & b, [F.col(n) for n in conditions])).select("visit_id")


def none_of(facts: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Visits of which no condition holds."""
    per = facts.groupBy("visit_id").agg(*[c.alias(name) for name, c in conditions.items()])
    return per.where(reduce(lambda a, b: a & b, [~F.col(n) for n in conditions])).select("visit_id")


def evaluate(facts: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """visit_id, rule_id, severity of each rule (id, severity, condition as an aggregate) that a visit's facts meet.

    All conditions are aggregates of one pass over the facts of a visit; several values of a code are alternatives.
    """
    per = facts.groupBy("visit_id").agg(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, s, c in rules])).alias("fired"))
    return per.select("visit_id", F.inline("fired"))


def trigger_rules(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of one code each (rule_id, code, severity) that a visit's facts have."""
    return facts.select("visit_id", "code").distinct().join(rules, "code").select("visit_id", "rule_id", "severity")


def stratified(facts: DataFrame, strata: list[list[tuple[str, Column, list[str], list[str]]]]) -> DataFrame:
    """Rules in strata of falling salience: (id, condition, ids that must have fired, ids that must not).

    Conditions are aggregated once; strata are then column expressions over the set fired so far.
    """
    flat = [r for layer in strata for r in layer]
    per = facts.groupBy("visit_id").agg(*[c.alias(f"c_{i}") for i, c, _, _ in flat]).withColumn("fired", F.array().cast("array<string>"))
    for layer in strata:
        new = []
        for i, _, need, without in layer:
            ok = F.col(f"c_{i}") & (F.size(F.array_except(F.array(*map(F.lit, need)).cast("array<string>"), "fired")) == 0) & ~F.arrays_overlap(F.array(*map(F.lit, without)).cast("array<string>"), "fired")
            new.append(F.when(ok, F.lit(i)))
        per = per.withColumn("fired", F.concat("fired", F.array_compact(F.array(*new))))
    return per.select("visit_id", F.explode("fired").alias("rule_id"))


def recompute(facts: DataFrame, old: DataFrame, changed: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Results of all visits after those changed are evaluated anew."""
    ids = changed.select("visit_id").distinct()
    fresh = evaluate(facts.join(ids, "visit_id", "left_semi"), rules)
    return old.join(ids, "visit_id", "left_anti").unionByName(fresh)
