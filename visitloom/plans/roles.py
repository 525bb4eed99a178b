"""Queries of speakers' roles, over turns of conversations and vectors as voices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.operators import linkage as li
from visitloom.operators import roles as o
from visitloom.plans.bindings import SEGMENTS, segments
from visitloom.plans.joins import vectors
from visitloom.plans.registry import Tables, query

QUESTIONS, CLINICIAN, PATIENT = ["?", "is "], ["the", "ver"], ["que", "in "]


def _count(words: list[str]) -> str:
    low = "(lower(text) || ' ')"
    return "(" + " + ".join(f"(length({low}) - length(replace({low}, '{w}', ''))) / {len(w)}" for w in words) + ")"


SCORES = f"""{SEGMENTS}, s as (select job_id, speaker, sum({_count(QUESTIONS)} + 2 * {_count(CLINICIAN)}) c, sum(2 * {_count(PATIENT)}) p from segments group by 1, 2),
  sc as (select job_id, speaker as cluster, case when c + p > 0 then round((c - p) / (c + p), 6) else 0 end::double score from s)"""


def _scores(t: Tables) -> DataFrame:
    texts = segments(t).select(F.struct("job_id", F.col("speaker").alias("cluster")).alias("cluster"), "text")
    return o.text_role_score(texts, QUESTIONS, CLINICIAN, PATIENT).select("cluster.*", "score")


@query("agg_24", f"with {SCORES} select job_id || '-' || cluster as cluster, score from sc")
def agg_24(t: Tables) -> DataFrame:
    return _scores(t).select(F.concat_ws("-", F.col("job_id").cast("string"), "cluster").alias("cluster"), "score")


# A speaker's voice is the vector of its number, unless the conversation's is a multiple of four; three vectors are the profile.
@query("rol_01", f"""with {SCORES}, pr as (select embedding::double[] p from embeddings where vec_id in (1, 2, 3)), v as (select vec_id, round(max(list_cosine_similarity(embedding::double[], p)), 6) voice from embeddings, pr group by 1),
  a as (select job_id, cluster, score as text, case when job_id % 4 > 0 then voice end voice from sc left join v on vec_id = job_id * 3 + case cluster when 'user' then 1 else 0 end),
  h as (select *, count(voice) over j = count(*) over j heard, count(*) over j n from a window j as (partition by job_id)),
  g as (select *, round(case when heard then 0.7 * (voice + 1) / 2 + (1 - 0.7) * (text + 1) / 2 else (text + 1) / 2 end, 9) score from h),
  k as (select *, row_number() over w k, score - lead(score) over w gap, first(cluster) over (partition by job_id order by text desc, cluster) bt, first(cluster) over (partition by job_id order by voice desc nulls last, cluster) bv from g window w as (partition by job_id order by score desc, cluster)),
  t as (select * exclude (gap), round(max(gap) filter (where k = 1) over (partition by job_id), 9) gap, abs(max(text) over (partition by job_id)) > 0.3 sure, max(abs(text)) over (partition by job_id) > 0 said from k),
  u as (select *, case when heard and bt <> bv and sure then gap / 2 else gap end used, case when text > 0.2 then 'doctor' when text < -0.2 then 'patient' else 'unknown' end lone from t)
  select job_id, cluster, case when n = 1 then lone when gap < 0.06 then 'unknown' when k = 1 then 'doctor' else 'patient' end as role,
    case when n = 1 then case lone when 'unknown' then 'fallback' else 'text' end when gap < 0.06 then 'fallback' when heard then case when said then 'voice+text' else 'voice' end else 'text' end basis,
    round(case when n = 1 then 0 when gap < 0.06 then gap else used end, 4)::double margin, round(case when n = 1 then abs(text) when gap < 0.06 then 0 else least(1, 0.5 + used) end, 4)::double confidence from u""")
def rol_01(t: Tables) -> DataFrame:
    rows = vectors(t).select("id", "v")
    voices = li.best_prototype(rows, rows.where("id in (1, 2, 3)").select(F.col("id").alias("label"), F.col("v").alias("p"))).select(F.col("id").alias("vec"), F.col("similarity").alias("voice"))
    said = _scores(t).withColumn("vec", F.col("job_id") * 3 + F.when(F.col("cluster") == "user", 1).otherwise(0))
    heard = said.join(voices, "vec", "left").select("job_id", "cluster", F.col("score").alias("text"), F.when(F.col("job_id") % 4 > 0, F.col("voice")).alias("voice"))
    return o.assign_roles(heard)
