"""Who speaks: scores of what speakers say and how they sound, compared within each recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of the voice where there is one; least lead of the first; text score of a lone speaker; score of a text that may
#: contradict the voice.
VOICE, MARGIN, ALONE, SURE = 0.7, 0.06, 0.2, 0.3


def text_role_score(texts: DataFrame, questions: list[str], clinician: list[str], patient: list[str]) -> DataFrame:
    """Per cluster of texts (cluster, text): 1 clearly the clinician, -1 clearly the patient, 0 without any marker.

    Questions weigh 1, what clinicians and patients say 2; a marker counts as often as it stands, without overlaps.
    """

    def hits(words: list[str]) -> Column:
        text = F.concat(F.lower(F.coalesce("text", F.lit(""))), F.lit(" "))
        return sum(((F.length(text) - F.length(F.replace(text, F.lit(w)))) / len(w) for w in words), F.lit(0.0))

    sums = texts.groupBy("cluster").agg(F.sum(hits(questions) + 2 * hits(clinician)).alias("c"), F.sum(2 * hits(patient)).alias("p"))
    both = F.col("c") + F.col("p")
    return sums.select("cluster", F.when(both > 0, F.round((F.col("c") - F.col("p")) / both, 6)).otherwise(0.0).alias("score"))


def assign_roles(clusters: DataFrame, margin: float = MARGIN) -> DataFrame:
    """job_id, cluster, role, basis, margin, confidence of the clusters (job_id, cluster, text, voice) of each recording.

    text is a score from -1 to 1, voice the likeness to the doctor's profile, null where there is none; unless all of a
    recording's clusters have one, text alone counts. A lone speaker is doctor or patient by text beyond ALONE. Of several
    the first by score is the doctor, if its lead is margin or more, and the others are patients; else all are unknown.
    Where text alone would choose another than voice alone, and surely, the lead counts half. Ties go to the first name.
    """
    job = Window.partitionBy("job_id")
    with_voice = F.count("voice").over(job) == F.count("*").over(job)
    n = F.count("*").over(job)
    text_part, voice_part = (F.col("text") + 1) / 2, (F.col("voice") + 1) / 2
    mixed = F.round(F.when(F.col("heard"), VOICE * voice_part + (1 - VOICE) * text_part).otherwise(text_part), 9)
    scored = clusters.withColumns({"heard": with_voice, "n": n}).withColumn("score", mixed)

    def first(column: str) -> Column:
        return F.first("cluster").over(job.orderBy(F.col(column).desc(), "cluster"))

    by = job.orderBy(F.col("score").desc(), "cluster")
    ranked = scored.withColumns({"k": F.row_number().over(by), "lead": F.col("score") - F.lead("score").over(by), "by_text": first("text"), "by_voice": first("voice")})
    gap = F.round(F.max(F.when(F.col("k") == 1, F.col("lead"))).over(job), 9)
    surest = F.max("text").over(job)
    told = ranked.withColumns({"gap": gap, "surest": surest, "any_text": F.max(F.abs("text")).over(job) > 0})
    apart = F.col("heard") & (F.col("by_text") != F.col("by_voice")) & (F.abs("surest") > SURE)
    used = F.when(apart, F.col("gap") / 2).otherwise(F.col("gap"))
    alone, close = F.col("n") == 1, F.col("gap") < margin
    lone = F.when(F.col("text") > ALONE, "doctor").when(F.col("text") < -ALONE, "patient").otherwise("unknown")
    role = F.when(alone, lone).when(close, "unknown").when(F.col("k") == 1, "doctor").otherwise("patient")
    basis = F.when(alone, F.when(lone == "unknown", "fallback").otherwise("text")).when(close, "fallback").when(F.col("heard"), F.when(F.col("any_text"), "voice+text").otherwise("voice")).otherwise("text")
    sure = F.when(alone, F.abs("text")).when(close, 0.0).otherwise(F.least(F.lit(1.0), 0.5 + used))
    return told.select("job_id", "cluster", role.alias("role"), basis.alias("basis"), F.round(F.when(alone, 0.0).when(close, F.col("gap")).otherwise(used), 4).alias("margin"), F.round(sure, 4).alias("confidence"))
