"""Queries of ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.operators import discourse as o
from visitloom.plans.bindings import ITEMS, SEGMENTS, items, segments
from visitloom.plans.joins import MEANS, TIMED, class_means, timed, vectors
from visitloom.plans.registry import Tables, query


@query("win_01", "select min(doc_id) doc_id, count(*)::bigint - 1 removed from documents group by text")
def win_01(t: Tables) -> DataFrame:
    return o.dedupe_first(t.documents.select("doc_id", "text"), "text", "doc_id").select("doc_id", "removed")


@query("win_02", f"with {ITEMS} select item_id, label, confidence from (select *, row_number() over (partition by label order by confidence desc, item_id) n from items) where n <= 200")
def win_02(t: Tables) -> DataFrame:
    return o.quota(items(t), "label", [F.col("confidence").desc(), F.col("item_id")], 200).select("item_id", "label", "confidence")


@query("win_03", """with l as (select doc_id, max(quality) quality from labels group by 1), r as (select doc_id, quality, count(*) over (partition by quality) n, row_number() over (partition by quality order by md5('7:' || quality || ':' || doc_id), doc_id) nth from l),
  s as (select *, round_even(n * 0.15, 0) sh from r), a as (select *, least(case when n >= 3 then greatest(sh, 1) else sh end, n - 1) te, case when n >= 3 then greatest(sh, 1) else sh end le from s)
  select doc_id, quality, case when nth <= te then 'test' when nth <= te + least(le, n - te - 1) then 'val' else 'train' end part from a""")
def win_03(t: Tables) -> DataFrame:
    rows = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return o.stratified_split(rows, "quality", "doc_id", "7")


@query("win_04", f"with {SEGMENTS}, {TIMED}, g as (select recording, seg, start - lag(stop) over (partition by recording order by seg) gap from s) select recording, seg, coalesce(gap between -0.25 and 1.5, false) continues from g")
def win_04(t: Tables) -> DataFrame:
    return o.continuation_flags(timed(t)[0], "recording", "start", "end", "seg").select("recording", "seg", "continues")


FLAG = "contains(lower(text), ' the ')"


@query("win_05", f"with {SEGMENTS} select job_id, order_index, coalesce(max({FLAG}) over (partition by job_id order by order_index rows between 2 preceding and current row), false) near, max(contains(lower(text), ' of ')) over (partition by job_id order by order_index) since from segments")
def win_05(t: Tables) -> DataFrame:
    rows = segments(t)
    flag = F.lower("text").contains(" the ")
    return rows.select("job_id", "order_index", o.context_window(rows, flag, 2).alias("near"), o.ever_since(F.lower("text").contains(" of ")).alias("since"))


@query("win_06", f"with {SEGMENTS}, f as (select *, coalesce(max({FLAG}) over (partition by job_id order by order_index rows between 2 preceding and 1 preceding), false) b from segments) select job_id, order_index, case when b and contains(lower(text), ' of ') then 'confirmed' when b then 'suspected' else 'none' end finding from f")
def win_06(t: Tables) -> DataFrame:
    rows = segments(t).withColumn("b", o.context_window(None, F.lower("text").contains(" the "), 2, -1))
    return rows.select("job_id", "order_index", F.when(F.col("b") & F.lower("text").contains(" of "), "confirmed").when(F.col("b"), "suspected").otherwise("none").alias("finding"))


@query("win_07", f"""with recursive {SEGMENTS}, f as (select job_id, order_index, row_number() over (partition by job_id order by order_index) n, length(text) % 3 = 0 o, length(text) % 5 = 0 c, length(text) % 2 = 0 j, length(text) % 11 = 0 d from segments),
  w as (select job_id, order_index, n, case when o then 'condition' else 'none' end tag from f where n = 1
    union all select f.job_id, f.order_index, f.n, case when o then 'condition' when w.tag <> 'condition' then 'none' when c then 'action' when j or d then 'condition' else 'none' end from w join f on f.job_id = w.job_id and f.n = w.n + 1)
  select job_id, order_index, tag from w""")
def win_07(t: Tables) -> DataFrame:
    n = F.length("text")
    return o.conditional_scope(segments(t).select("job_id", "order_index", (n % 3 == 0).alias("opens"), (n % 5 == 0).alias("closes"), (n % 2 == 0).alias("joins"), (n % 11 == 0).alias("danger")))


@query("win_08")
def win_08(t: Tables) -> DataFrame:
    rows = segments(t).select("job_id", "order_index", "speaker", "text", (F.length("text") % 10 / 10).alias("confidence"), (F.length("text") % 7 == 0).alias("is_suspect"))
    return o.merge_short(rows, 60, 400)


@query("win_09")
def win_09(t: Tables) -> DataFrame:
    words = F.transform(F.split("text", r"\s+"), lambda w, i: F.struct(w.alias("word"), (i * 0.4 + F.floor(i / 9) * 0.7).alias("start"), (i * 0.4 + F.floor(i / 9) * 0.7 + 0.3).alias("end")))
    return o.split_by_words(segments(t).select(F.concat_ws("-", F.col("job_id").cast("string"), F.col("order_index").cast("string")).alias("id"), words.alias("words")))


@query("win_10")
def win_10(t: Tables) -> DataFrame:
    return o.split_by_count(t.conversations.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", F.lit(0.0).alias("start"), (F.length("text") / 10).alias("end")))


@query("win_11")
def win_11(t: Tables) -> DataFrame:
    return o.build_segments(*timed(t))


@query("win_12", f"""with {MEANS}, q as (select vec_id id, e.label, round(sqrt(list_sum(list_transform(list_zip(embedding::double[], p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) distance from embeddings e join c on e.label = c.label)
  select id, label, distance, rank::int as rank from (select *, row_number() over (partition by label order by distance, id) as rank from q) where rank <= 6""")
def win_12(t: Tables) -> DataFrame:
    return o.representatives(vectors(t), class_means(t), 6)


@query("win_15", """with s as (select doc_id id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::bigint n from documents), p as (select id, n, (sum(n) over (order by id) - n)::bigint b, sum(n) over () total from s where n > 0),
  l as (select *, unnest(range(b // 512, (b + n - 1) // 512 + 1)) blk from p)
  select blk as block, id, greatest(b - blk * 512, 0)::bigint "at", (least(b + n, (blk + 1) * 512) - greatest(b, blk * 512))::bigint n from l where blk < total // 512""")
def win_15(t: Tables) -> DataFrame:
    return o.pack_blocks(t.documents.select(F.col("doc_id").alias("id"), "text"), 512)
