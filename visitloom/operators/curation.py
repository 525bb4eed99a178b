"""Curating labelled text: what may teach a classifier and what not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rejection(least_confidence: float, most_ood: float) -> Column:
    """Why an item isn't taken as a self-label, the first reason; accepted if there is none. Null ood passes."""
    return F.when(F.col("is_suspect"), "suspect").when(F.col("is_corrected"), "corrected").when(F.col("confidence") < least_confidence, "confidence").when(F.col("ood") > most_ood, "ood").otherwise("accepted")


def export_training(corrections: DataFrame, items: DataFrame, at: Column, confirmed: bool = True, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Rows to train on, and the corrections after them.

    corrections: item_id, field, old_value, new_value, exported_at; items: item_id, text, label, is_corrected,
    review_priority. Label corrections that weren't exported before become human rows (item_id, text, label, source,
    was_predicted), unless their item is missing or blank; confirmed adds up to most items that were reviewed and left
    alone, those of the highest priority. The corrections come back with an outcome (human, skipped, or null where they
    aren't pending labels), and exported_at set where they had none and are labels.
    """
    texts = items.select("item_id", "text", F.lit(True).alias("there"))
    pending = (F.col("field") == "label") & F.col("exported_at").isNull()
    usable = F.col("there").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")
    told = corrections.join(texts, "item_id", "left").withColumn("outcome", F.when(pending, F.when(usable, "human").otherwise("skipped")))
    human = told.where("outcome = 'human'").select("item_id", "text", F.col("new_value").alias("label"), F.lit("human").alias("source"), F.col("old_value").alias("was_predicted"))
    if confirmed:
        sure = items.where("not is_corrected and review_priority > 0").orderBy(F.col("review_priority").desc(), "item_id").limit(most)
        human = human.unionByName(sure.select("item_id", "text", "label", F.lit("confirmed").alias("source"), F.lit(None).cast("string").alias("was_predicted")))
    marked = told.withColumn("exported_at", F.when(pending, at).otherwise(F.col("exported_at"))).drop("text", "there")
    return human, marked
