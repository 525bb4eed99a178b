"""Keyed updates: old and new tables in, the new table out; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame, tasks: int | None, *key: str) -> DataFrame:
    """df dealt by key to so many partitions if that is more than the session's number; else as it is."""
    if tasks is None or tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, *key)


def ensure(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """All existing rows and those incoming whose key is new, once per key."""
    fresh = incoming.join(existing.select(*key), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*[c for c in fresh.columns]))
    return existing.unionByName(fresh.withColumn("nth", first).where("nth = 1").drop("nth"), allowMissingColumns=True)


def replace_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows of the jobs they are of, and the old rows of all others."""
    return old.join(new.select("job_id").distinct(), "job_id", "left_anti").unionByName(new)


def link_entities(items: DataFrame) -> DataFrame:
    """item_id, job_id, kind, code, assertion, value, status: the entities that items' links (job_id, item_id, links) name.

    Items without links and links without a code have none; a value that is no number is null, true and false too; kind
    and assertion are clinical and present where a link says nothing.
    """
    rows = items.select("item_id", "job_id", F.explode("links").alias("l")).where("coalesce(l.code, '') <> ''")
    return rows.select("item_id", "job_id", F.coalesce("l.kind", F.lit("clinical")).alias("kind"), "l.code", F.coalesce("l.assertion", F.lit("present")).alias("assertion"), F.expr("try_cast(l.value as double)").alias("value"), "l.status")


def save_report(old_items: DataFrame, old_entities: DataFrame, new_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and their entities after jobs were reported anew: of those jobs only what is new, of all others what was."""
    jobs = new_items.select("job_id").distinct()
    items = old_items.join(jobs, "job_id", "left_anti").unionByName(new_items.select(old_items.columns))
    return items, old_entities.join(jobs, "job_id", "left_anti").unionByName(link_entities(new_items).select(old_entities.columns))


def sync_suggestions(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without a match retired, matches updated in place with their id, others inserted with an id from the key."""
    o = old.select(*key, F.col("id").alias("old_id"), F.col("severity").alias("old_severity"))
    n = new.select(*key, F.col("severity").alias("new_severity"))
    both = o.join(n, key, "full")
    made = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return both.select(*key, F.coalesce("old_id", made).alias("id"), F.coalesce("new_severity", "old_severity").alias("severity"), F.col("new_severity").isNotNull().alias("is_active"))


def retire(suggestions: DataFrame, jobs: DataFrame) -> DataFrame:
    gone = jobs.select("job_id").distinct().withColumn("gone", F.lit(True))
    return suggestions.join(gone, "job_id", "left").withColumn("is_active", F.col("is_active") & F.col("gone").isNull()).drop("gone")


def apply_corrections(items: DataFrame, edits: DataFrame, section_of: dict[str, str], urgent: str) -> DataFrame:
    """Items with the last edit of each field; a changed label resets section, priority and urgency, a changed
    text is the clinician's, for certain. No-ops don't count.

    items: item_id, label, text, section, review_priority, is_urgent, is_corrected. edits: item_id, field, value, at.
    """
    last = edits.groupBy("item_id").pivot("field", ["label", "text"]).agg(F.max_by("value", F.struct("at", "value")))
    both = items.join(last.withColumnsRenamed({"label": "to_label", "text": "to_text"}), "item_id", "left")
    relabelled = F.coalesce(F.col("to_label") != F.col("label"), F.lit(False))
    rewritten = F.coalesce(F.col("to_text") != F.col("text"), F.lit(False))
    known = F.create_map(*[F.lit(x) for kv in section_of.items() for x in kv])
    return both.select(
        "item_id",
        F.when(relabelled, F.col("to_label")).otherwise(F.col("label")).alias("label"),
        F.when(rewritten, F.col("to_text")).otherwise(F.col("text")).alias("text"),
        F.when(relabelled, F.coalesce(known[F.col("to_label")], F.lit("subjective"))).otherwise(F.col("section")).alias("section"),
        F.when(relabelled, 0.0).otherwise(F.col("review_priority")).alias("review_priority"),
        F.when(relabelled, F.col("to_label") == urgent).otherwise(F.col("is_urgent")).alias("is_urgent"),
        (F.col("is_corrected") | relabelled | rewritten).alias("is_corrected"),
        F.when(rewritten, "clinician_corrected").alias("text_status"),
        F.when(rewritten, 1.0).alias("text_confidence"),
    )


def correction_log(items: DataFrame, edits: DataFrame, fields: tuple[str, ...] = ("label", "text", "section", "speaker"), tasks: int | None = None) -> DataFrame:
    """item_id, field, old, new, at, outcome of edits (item_id, field, value, at), in the order of each field's edits.

    Every edit is appended, none overwrites another: old is what the field had before it, by the item or by the edit
    before. outcome: applied; no_change where old and new are equal as strings, an error to whoever sent it; unknown_field
    and unknown_item likewise. tasks: how many partitions at least items and edits meet in.
    """
    held = [f for f in fields if f in items.columns]
    had = items.select("item_id", *[F.col(f).cast("string").alias(f"had_{f}") for f in held], F.lit(True).alias("there"))
    both = spread(edits, tasks, "item_id").join(spread(had, tasks, "item_id"), "item_id", "left")
    order = Window.partitionBy("item_id", "field").orderBy("at", "value")
    # What the item had is looked up by the field after the join, so that rows stay narrow in it.
    own = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("field") == f, F.col(f"had_{f}")) for f in held])
    told = both.select("item_id", "field", "value", "at", "there", own.alias("had")).withColumn("old", F.coalesce(F.lag("value").over(order), F.col("had")))
    outcome = F.when(F.col("there").isNull(), "unknown_item").when(~F.col("field").isin(*fields), "unknown_field").when(F.col("old").eqNullSafe(F.col("value")), "no_change").otherwise("applied")
    return told.select("item_id", "field", "old", F.col("value").alias("new"), "at", outcome.alias("outcome"))


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """created, existing or conflict for each request (key, fingerprint, at, id), by the first of its key."""
    order = Window.partitionBy("key").orderBy("at", "id")
    first = F.first("fingerprint").over(order)
    outcome = F.when(F.row_number().over(order) == 1, "created").when(F.col("fingerprint") == first, "existing").otherwise("conflict")
    return requests.select("id", "key", outcome.alias("outcome"))


def add_feedback(suggestions: DataFrame, feedback: DataFrame, actions: tuple[str, ...] = ("accept", "reject", "edit", "ignore")) -> DataFrame:
    """Feedback on active suggestions with a known action."""
    return feedback.where(F.col("action").isin(*actions)).join(suggestions.where("is_active").select("id"), "id", "left_semi")


def archive(new: DataFrame, catalog: DataFrame) -> DataFrame:
    """The objects of new (content), one per hash: sha256, key, size, was_new (whether the catalog hasn't got it)."""
    hashed = new.select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size")).dropDuplicates(["sha256"])
    key = F.concat_ws("/", F.lit("objects"), F.substring("sha256", 1, 2), "sha256")
    known = catalog.select("sha256", F.lit(False).alias("was_new")).distinct()
    return hashed.join(known, "sha256", "left").select("sha256", key.alias("key"), "size", F.coalesce("was_new", F.lit(True)).alias("was_new"))


def finalize(sessions: DataFrame, finals: DataFrame) -> DataFrame:
    """Complete sessions that have no snapshot yet."""
    return sessions.where("status = 'complete'").join(finals.select("job_id"), "job_id", "left_anti")


def with_extra(train: DataFrame, extra: DataFrame) -> DataFrame:
    """Training rows with extra ones whose label is known."""
    return train.unionByName(extra.join(train.select("label").distinct(), "label", "left_semi"), allowMissingColumns=True)


def fact_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """What facts of a text its rewrite lost, gained or changed. a, b: id, kind, code, value."""
    key = ["id", "kind", "code"]
    both = a.select(*key, F.col("value").alias("a"), F.lit(True).alias("in_a")).join(b.select(*key, F.col("value").alias("b"), F.lit(True).alias("in_b")), key, "full")
    reason = F.when(F.col("in_b").isNull(), "lost").when(F.col("in_a").isNull(), "introduced").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*key, reason.alias("reason")).where("reason is not null")
