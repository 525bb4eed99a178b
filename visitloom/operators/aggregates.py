"""Summaries of items, corrections, labels and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.operators.ranks import running


def archive_stats(audio: DataFrame, warn_gb: float) -> DataFrame:
    """audio: size (bytes), recorded_at, verified_at. One row."""
    gb = F.round(F.coalesce(F.sum("size"), F.lit(0)) / 1e9, 6)
    return audio.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.min("recorded_at").alias("oldest"), F.count_if(F.col("verified_at").isNull()).alias("never_verified"), gb.alias("gb"), (gb > warn_gb).alias("over"))


def confusions(corrections: DataFrame, top: int = 25) -> DataFrame:
    return corrections.groupBy("old_value", "new_value").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "old_value", "new_value").limit(top)


def correction_stats(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row: items, corrections, corrected items, their share (4 places)."""
    a = items.agg(F.count("*").alias("items"), F.count_if(F.col("is_corrected")).alias("corrected"))
    b = corrections.agg(F.count("*").alias("corrections"))
    return a.crossJoin(b).withColumn("rate", F.when(F.col("items") == 0, 0.0).otherwise(F.round(F.col("corrected") / F.col("items"), 4)))


def most_corrected(corrections: DataFrame, top: int = 10) -> DataFrame:
    return corrections.groupBy("old_value").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "old_value").limit(top)


def report_summary(items: DataFrame, low: float) -> DataFrame:
    """Per job: items, mean confidence (4 places), how many are below low, how many urgent, and counts of labels."""
    per = items.groupBy("job_id", "label").agg(F.count("*").alias("k"), F.sum("confidence").alias("c"), F.count_if(F.col("confidence") < low).alias("l"), F.count_if(F.col("is_urgent")).alias("u"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "k"))))
    return per.groupBy("job_id").agg(F.sum("k").alias("n"), F.round(F.sum("c") / F.sum("k"), 4).alias("avg_confidence"), F.sum("l").alias("low_count"), F.sum("u").alias("urgent_count"), counts.alias("label_counts"))


def transcript_quality(segments: DataFrame) -> DataFrame:
    return segments.groupBy("job_id").agg(F.round(F.avg("log_prob"), 6).alias("mean_log_prob"), F.round(F.count_if(F.col("is_suspect")) / F.count("*"), 6).alias("suspect_share"))


def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label")


def find_conflicts(rows: DataFrame, text: str, label: str, position: str) -> DataFrame:
    """Texts with more than one label: labels in first-seen order, and where the text was first seen."""
    firsts = rows.groupBy(text, label).agg(F.min(position).alias("at"), F.count("*").alias("k"))
    listed = F.array_sort(F.collect_list(F.struct("at", F.col(label).alias("label"))))
    return firsts.groupBy(text).agg(F.transform(listed, lambda x: x["label"]).alias("labels"), F.min("at").alias("first_at"), F.sum("k").alias("n")).where(F.size("labels") > 1)


def conflict_pairs(conflicts: DataFrame) -> DataFrame:
    """Sets of labels that meet, most frequent first."""
    return conflicts.groupBy(F.array_join(F.array_sort("labels"), " / ").alias("pair")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "pair")


def suggestion(labels: Column, sensitive: list[str]) -> Column:
    """The label that ends in another one of the set, after an underscore, and so says more; none if a label is sensitive."""
    special = F.filter(labels, lambda a: F.exists(labels, lambda b: (a != b) & a.endswith(F.concat(F.lit("_"), b))))
    return F.when(F.size(F.array_intersect(labels, F.array(*map(F.lit, sensitive)))) == 0, F.get(F.array_sort(special), F.lit(0)))


def coverage(texts: DataFrame, mentions: DataFrame, actionable: list[str]) -> DataFrame:
    """Per label: texts, those with a mention, those with a mention of an actionable kind, and the share (4 places)."""
    per = mentions.groupBy("id").agg(F.bool_or(F.col("kind").isin(actionable)).alias("useful"))
    return texts.join(per, "id", "left").groupBy("label").agg(F.count("*").alias("total"), F.count("useful").alias("covered"), F.count_if(F.col("useful")).alias("useful"), F.round(F.count("useful") / F.count("*"), 4).alias("share"))


def mentions_by_kind(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """label, kind, mentions, texts: of each label how many mentions of each kind there are, and in how many texts."""
    return texts.join(mentions, "id").groupBy("label", "kind").agg(F.count("*").alias("mentions"), F.count_distinct("id").alias("texts"))


def uncovered(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """The texts without any mention."""
    return texts.join(mentions.select("id").distinct(), "id", "left_anti")


def classification_report(pred: DataFrame) -> DataFrame:
    """Per class of gold or pred: precision, recall, f1 (6 places; 0 where undefined), support."""
    pairs = pred.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    by_gold = pairs.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    by_pred = pairs.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said"))
    both = by_gold.join(by_pred, "label", "full").na.fill(0, ["support", "hits", "said"])
    p = F.when(F.col("said") > 0, F.col("hits") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("hits") > 0, 2 * F.col("hits") / (F.col("said") + F.col("support"))).otherwise(0.0)
    return both.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def overall(report: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: macro and weighted F1, accuracy."""
    means = report.agg(F.round(F.avg("f1"), 5).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 5).alias("weighted_f1"))
    return means.crossJoin(pred.agg(F.round(F.count_if(F.col("gold") == F.col("pred")) / F.count("*"), 5).alias("accuracy")))


def ece(pred: DataFrame, bins: int = 15, by: str | None = None) -> DataFrame:
    """Expected calibration error of conf and hit over bins open on the left; a confidence of 0 is in none."""
    keys = [by] if by else []
    per = pred.withColumn("bin", F.ceil(F.col("conf") * bins)).groupBy(*keys, "bin").agg(F.count("*").alias("k"), F.avg("conf").alias("c"), F.avg(F.col("hit").cast("double")).alias("h"))
    gap = F.when(F.col("bin") > 0, F.col("k") * F.abs(F.col("c") - F.col("h"))).otherwise(0.0)
    return per.groupBy(*keys).agg(F.round(F.sum(gap) / F.sum("k"), 6).alias("ece"))


def nll(p: Column) -> Column:
    """Mean negative log-likelihood of the true class's probability."""
    return F.round(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))), 6)


def threshold_for_precision(pred: DataFrame, precision: float = 0.9, coverage: float = 0.3) -> DataFrame:
    """The highest cut whose accepted rows (conf >= cut) are right and many enough; cuts are confidences cut to 3 places.

    Rows are summed per thousandth first, so the running sums go over at most 1,001 rows.
    """
    per = pred.groupBy((F.floor(F.col("conf") * 1000) / 1000).alias("cut")).agg(F.count("*").alias("k"), F.sum(F.col("hit").cast("int")).alias("h"))
    above = Window.orderBy(F.col("cut").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    run = per.select("cut", F.sum("k").over(above).alias("n"), F.sum("h").over(above).alias("right"), F.sum("k").over(whole).alias("all"))
    return run.where((F.col("right") >= precision * F.col("n")) & (F.col("n") >= coverage * F.col("all"))).agg(F.max("cut").alias("threshold"))


def auroc(scores: DataFrame) -> DataFrame:
    """Of score and positive: the share of pairs in order, ties half. Sums per score, then running sums over scores, range
    by range. NaN if one side has no rows."""
    per = scores.groupBy("score").agg(F.count_if(F.col("positive")).alias("p"), F.count_if(~F.col("positive")).alias("n"))
    pairs = running(per, ["score"], ["n"]).select("p", "n", (F.col("p") * (F.col("before_n") + F.col("n") / 2)).alias("won"))
    return pairs.agg(F.when((F.sum("p") > 0) & (F.sum("n") > 0), F.round(F.sum("won") / (F.sum("p") * F.sum("n")), 8)).otherwise(float("nan")).alias("auroc"))


def coverage_at_k(items: DataFrame, orders: dict[str, list[Column]], k: int) -> DataFrame:
    """Per order: the mean, over jobs that have errors, of the share of a job's errors among its first k items."""
    out = None
    for name, order in orders.items():
        rank = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
        per = items.withColumn("rank", rank).groupBy("job_id").agg(F.count_if(F.col("is_error")).alias("errors"), F.count_if(F.col("is_error") & (F.col("rank") <= k)).alias("seen")).where("errors > 0")
        one = per.agg(F.lit(name).alias("by"), F.round(F.avg(F.col("seen") / F.col("errors")), 6).alias("coverage"), F.count("*").alias("jobs"))
        out = one if out is None else out.unionByName(one)
    return out


def counts_by_status(rows: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    return rows.groupBy(key).pivot(status, values).count().na.fill(0)


def child_count(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def dashboard_summary(sessions: DataFrame, finals: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row of counts for a day: sessions, in progress, failed, approved."""
    a = sessions.where((F.col("visit_at") >= start) & (F.col("visit_at") < end)).agg(F.count("*").alias("sessions"), F.count_if(F.col("status") == "running").alias("in_progress"), F.count_if(F.col("status") == "failed").alias("failed"))
    b = finals.where((F.col("finalized_at") >= start) & (F.col("finalized_at") < end)).agg(F.count("*").alias("approved"))
    return a.crossJoin(b)


def weekly_activity(sessions: DataFrame, finals: DataFrame, now: Column, zone: str) -> DataFrame:
    """The seven local days up to now: date, short name, sessions and approvals, 0 where there are none."""
    spark = sessions.sparkSession
    today = F.to_date(F.from_utc_timestamp(now, zone))
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, 6), today)).alias("day"))
    a = sessions.groupBy(F.to_date(F.from_utc_timestamp("visit_at", zone)).alias("day")).agg(F.count("*").alias("sessions"))
    b = finals.groupBy(F.to_date(F.from_utc_timestamp("finalized_at", zone)).alias("day")).agg(F.count("*").alias("approved"))
    return days.join(a, "day", "left").join(b, "day", "left").select("day", F.date_format("day", "EEE").alias("name"), F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("approved", F.lit(0)).alias("approved"))


def merge_suggestions(fired: DataFrame, lists: tuple[str, ...] = ("evidence", "tests")) -> DataFrame:
    """Per visit and key: the first firing's severity and title, and the unions of lists (evidence, tests, chain,
    references), so that a merge loses nothing."""
    unions = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    return fired.groupBy("visit_id", "dedupe_key").agg(F.min_by("severity", "seq").alias("severity"), F.min_by("title", "seq").alias("title"), *unions)


def latest_numeric(facts: DataFrame, code: str) -> DataFrame:
    """Per visit: the value of a code's last fact; null if that isn't a number."""
    return facts.where(F.col("code") == code).groupBy("visit_id").agg(F.max_by(F.expr("try_cast(value as double)"), F.struct("report_index", "item_pos")).alias("value"))


def persistent(facts: DataFrame) -> DataFrame:
    """Codes that a patient has, not negated, in two visits or more: how many, and the first fact of each as evidence."""
    per = facts.where(~F.col("negated")).groupBy("patient_id", "code", "visit_id").agg(F.min("fact_id").alias("fact_id"))
    return per.groupBy("patient_id", "code").agg(F.count("*").alias("visits"), F.array_sort(F.collect_list("fact_id")).alias("evidence")).where("visits >= 2")


def worsening(facts: DataFrame, delta: float = 10.0) -> DataFrame:
    """Codes whose readings (not 0) rise by delta or more from a patient's first to the last."""
    at = F.struct("at", "fact_id")
    ends = facts.where("value <> 0").groupBy("patient_id", "code").agg(F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last"), F.min_by("fact_id", at).alias("first_id"), F.max_by("fact_id", at).alias("last_id"), F.count("*").alias("n"))
    return ends.where(F.col("n") >= 2).withColumn("rise", F.round(F.round(F.col("last") - F.col("first"), 6), 1)).where(F.col("last") - F.col("first") >= delta)


def detect_context(items: DataFrame) -> DataFrame:
    """Per visit: pregnant (denied only if nothing says so; a week says so), postpartum, first week and trimester."""
    said = F.bool_or(F.col("pregnant")) | F.min(F.when(F.col("week").isNotNull(), 1)).isNotNull()
    state = F.when(said, True).when(F.bool_or(~F.col("pregnant")), False)
    week = F.min_by("week", F.when(F.col("week").isNotNull(), F.col("pos")))
    return items.groupBy("visit_id").agg(state.alias("pregnant"), F.coalesce(F.bool_or("postpartum"), F.lit(False)).alias("postpartum"), week.alias("week"))


def sections(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per job and key: the key's item texts in order; every key is there."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("order_index", "text"))), lambda x: x["text"])
    got = items.groupBy("job_id", "section").agg(listed.alias("texts"))
    jobs = items.select("job_id").distinct().withColumn("section", F.explode(F.array(*map(F.lit, keys))))
    return jobs.join(got, ["job_id", "section"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def section_text(items: DataFrame) -> DataFrame:
    """Per job and section: clauses in order without case-folded repeats, joined; and the ids of all items."""
    rows = F.array_sort(F.collect_list(F.struct("order_index", "text", "item_id")))
    clauses = F.transform(rows, lambda x: F.trim(x["text"]))
    folded = F.transform(clauses, F.lower)
    first = F.filter(F.transform(clauses, lambda c, i: F.when(F.array_position(folded, F.lower(c)) == i + 1, c)), lambda c: c.isNotNull() & (c != ""))
    return items.groupBy("job_id", "section").agg(F.array_join(first, "; ").alias("paragraph"), F.transform(rows, lambda x: x["item_id"]).alias("item_ids"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weights that add up to the number of classes (6 places)."""
    n = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return n.select("label", "n", F.round(1 / F.col("n") / F.sum(1 / F.col("n")).over(whole) * F.count("*").over(whole), 6).alias("weight"))


# What a row counts by where its label comes from.
SOURCE_WEIGHTS = {"human": 3.0, "confirmed": 2.0, "pseudo": 0.3, "synthetic": 1.0}


def source_weight(source: Column, overrides: dict[str, float] | None = None) -> Column:
    """The weight of a row by its source: overrides first; without a source it is a human's, of an unknown one 1."""
    known = F.create_map(*[F.lit(x) for kv in (SOURCE_WEIGHTS | (overrides or {})).items() for x in kv])
    return F.coalesce(known[F.coalesce(source, F.lit("human"))], F.lit(1.0))


def label_ids(rows: DataFrame, label: str) -> DataFrame:
    return rows.select(F.col(label).alias("label")).where("label is not null").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("id"))
