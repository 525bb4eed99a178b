"""Queries of summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.operators import aggregates as o
from visitloom.operators.filters import local_day_bounds
from visitloom.operators.phrases import mine_phrases
from visitloom.plans.bindings import FACTS, ITEMS, JOBS, SEGMENTS, STATES, facts, items, jobs, segments, states
from visitloom.plans.registry import Tables, query
from visitloom.plans.rows import CORRECTIONS, PRIORITY, corrections, with_priority


@query("agg_01", "select count(*)::bigint n, sum(n_chars)::bigint bytes, min(doc_id) oldest, count(*) filter (where toxic is null)::bigint never_verified, round(sum(n_chars) / 1e9, 6) gb, round(sum(n_chars) / 1e9, 6) > 0.001 as \"over\" from documents left join (select doc_id, max(toxic) toxic from labels group by 1) using (doc_id)")
def agg_01(t: Tables) -> DataFrame:
    seen = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("verified_at"))
    return o.archive_stats(t.documents.select("doc_id", F.col("n_chars").alias("size"), F.col("doc_id").alias("recorded_at")).join(seen, "doc_id", "left"), 0.001)


@query("agg_02", f"with {CORRECTIONS} select old_value, new_value, count(*)::bigint n from corrections group by all order by n desc, 1, 2 limit 25")
def agg_02(t: Tables) -> DataFrame:
    return o.confusions(corrections(t))


@query("agg_02_rate", f"with {CORRECTIONS} select (select count(*) from items)::bigint as items, (select count(*) from items where is_corrected)::bigint corrected, (select count(*) from corrections)::bigint as corrections, round((select count(*) from items where is_corrected) / (select count(*) from items), 4) rate")
def agg_02_rate(t: Tables) -> DataFrame:
    return o.correction_stats(items(t), corrections(t))


@query("agg_02_labels", f"with {CORRECTIONS} select old_value, count(*)::bigint n from corrections group by all order by n desc, 1 limit 10")
def agg_02_labels(t: Tables) -> DataFrame:
    return o.most_corrected(corrections(t))


@query("agg_03", f"""with {ITEMS}, c as (select job_id, label, count(*) k from items group by all)
  select job_id, count(*)::bigint n, round(avg(confidence), 4) avg_confidence, count(*) filter (where confidence < 0.3)::bigint low_count, count(*) filter (where ood > 0.7)::bigint urgent_count,
  (select map_from_entries(list(row(label, k) order by label)) from c where c.job_id = items.job_id) label_counts from items group by job_id""")
def agg_03(t: Tables) -> DataFrame:
    return o.report_summary(items(t).withColumn("is_urgent", F.col("ood") > 0.7), 0.3)


@query("agg_04", f"with {ITEMS} select job_id, round(avg(case when confidence > 0 then -confidence end), 6) mean_log_prob, round(count(*) filter (where is_suspect) / count(*), 6) suspect_share from items group by 1")
def agg_04(t: Tables) -> DataFrame:
    return o.transcript_quality(items(t).withColumn("log_prob", F.when(F.col("confidence") > 0, -F.col("confidence"))))


@query("agg_05", "select quality as label, count(*)::bigint n from labels group by 1 order by n desc, 1")
def agg_05(t: Tables) -> DataFrame:
    return o.class_distribution(t.labels, "quality")


CONFLICTS = """firsts as (select text, source as label, min(doc_id) as seen_at, count(*) k from documents group by all),
  conflicts as (select text, list(label order by seen_at, label) labels, min(seen_at) first_at, sum(k)::bigint n from firsts group by text having count(*) > 1)"""


def _conflicts(t: Tables) -> DataFrame:
    return o.find_conflicts(t.documents.select("text", F.col("source").alias("label"), "doc_id"), "text", "label", "doc_id")


@query("agg_06", f"with {CONFLICTS} select md5(text) digest, labels, first_at, n from conflicts")
def agg_06(t: Tables) -> DataFrame:
    return _conflicts(t).select(F.md5("text").alias("digest"), "labels", "first_at", "n")


@query("agg_07", f"with {CONFLICTS} select array_to_string(list_sort(labels), ' / ') pair, count(*)::bigint n from conflicts group by 1 order by n desc, 1")
def agg_07(t: Tables) -> DataFrame:
    return o.conflict_pairs(_conflicts(t))


@query("agg_07_suggest", f"with {CONFLICTS}, e as (select first_at, list_concat(labels, ['sub' || labels[1], 'new_' || labels[2]]) labels from conflicts) select first_at, case when not list_has_any(labels, ['forum']) then list_sort(list_filter(labels, lambda a: len(list_filter(labels, lambda b: a <> b and ends_with(a, '_' || b))) > 0))[1] end suggestion from e")
def agg_07_suggest(t: Tables) -> DataFrame:
    """Two labels are added: one that only ends in the first, and one that is the second's special case."""
    more = F.array(F.concat(F.lit("sub"), F.get("labels", F.lit(0))), F.concat(F.lit("new_"), F.get("labels", F.lit(1))))
    rows = _conflicts(t).withColumn("labels", F.concat("labels", more))
    return rows.select("first_at", o.suggestion(F.col("labels"), ["forum"]).alias("suggestion"))


@query("agg_08", """with m as (select doc_id id, bool_or(quality = 1) useful from labels group by 1)
  select lang as label, count(*)::bigint total, count(useful)::bigint covered, count(*) filter (where useful)::bigint useful, round(count(useful) / count(*), 4) share from documents left join m on doc_id = id group by 1""")
def agg_08(t: Tables) -> DataFrame:
    mentions = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("kind"))
    return o.coverage(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")), mentions, ["good"])


@query("agg_08_kinds", "select lang as label, case when quality = 1 then 'good' else 'poor' end kind, count(*)::bigint mentions, count(distinct doc_id)::bigint texts from documents join labels using (doc_id) group by 1, 2")
def agg_08_kinds(t: Tables) -> DataFrame:
    mentions = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("kind"))
    return o.mentions_by_kind(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")), mentions)


@query("agg_08_uncovered", "select doc_id id, lang as label from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def agg_08_uncovered(t: Tables) -> DataFrame:
    return o.uncovered(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")), t.labels.select(F.col("doc_id").alias("id")))


@query("agg_18", f"""with {ITEMS}, p as (select *, {PRIORITY} rp from items),
  r as (select job_id, is_corrected e, row_number() over (partition by job_id order by rp desc, item_id) a, row_number() over (partition by job_id order by order_index) b,
    row_number() over (partition by job_id order by md5(item_id), item_id) c from p),
  s as (select job_id, count(*) filter (where e) errors, count(*) filter (where e and a <= 3) a, count(*) filter (where e and b <= 3) b, count(*) filter (where e and c <= 3) c from r group by 1 having errors > 0)
  select 'priority' as by, round(avg(a / errors), 6) coverage, count(*)::bigint jobs from s union all select 'document', round(avg(b / errors), 6), count(*) from s union all select 'random', round(avg(c / errors), 6), count(*) from s""")
def agg_18(t: Tables) -> DataFrame:
    rows = with_priority(items(t)).withColumn("is_error", F.col("is_corrected"))
    orders = {"priority": [F.col("review_priority").desc(), F.col("item_id")], "document": [F.col("order_index")], "random": [F.md5("item_id"), F.col("item_id")]}
    return o.coverage_at_k(rows, orders, 3)


@query("agg_19", f"with {JOBS} select patient_id, count(*) filter (where status = 'queued')::bigint queued, count(*) filter (where status = 'running')::bigint running, count(*) filter (where status = 'complete')::bigint complete from jobs group by 1")
def agg_19(t: Tables) -> DataFrame:
    return o.counts_by_status(jobs(t), "patient_id", "status", ["queued", "running", "complete"])


@query("agg_20", f"with {JOBS}, n as (select patient_id, count(*) n from jobs group by 1) select c_custkey patient_id, coalesce(n, 0)::bigint n from customer left join n on c_custkey = patient_id")
def agg_20(t: Tables) -> DataFrame:
    return o.child_count(t.customer.select(F.col("c_custkey").alias("patient_id")), jobs(t), "patient_id")


def _sessions(t: Tables) -> tuple[DataFrame, DataFrame]:
    kinds = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("complete")
    sessions = t.events.select(F.col("ts").alias("visit_at"), kinds.alias("status"))
    return sessions, t.events.where("event_type = 'purchase'").select(F.col("ts").alias("finalized_at"))


@query("agg_21", """select count(*)::bigint sessions, count(*) filter (where event_type = 'view')::bigint in_progress, count(*) filter (where event_type = 'error')::bigint failed, count(*) filter (where event_type = 'purchase')::bigint approved
  from events where ts >= timestamp '2024-01-09 23:00:00' and ts < timestamp '2024-01-10 23:00:00'""")
def agg_21(t: Tables) -> DataFrame:
    return o.dashboard_summary(*_sessions(t), *local_day_bounds("Europe/Paris", F.lit("2024-01-10 12:00:00").cast("timestamp")))


@query("agg_22", """with d as (select unnest(generate_series(date '2024-01-25', date '2024-01-31', interval 1 day))::date as day)
  select day, strftime(day, '%a') as name, count(ts)::bigint sessions, count(*) filter (where event_type = 'purchase')::bigint approved
  from d left join events on (ts + interval 1 hour)::date = day group by 1""")
def agg_22(t: Tables) -> DataFrame:
    return o.weekly_activity(*_sessions(t), F.lit("2024-01-31 12:00:00").cast("timestamp"), "Europe/Paris")


@query("agg_23", f"with {CORRECTIONS} select (select count(*) from items)::bigint as items, (select count(*) from items where is_corrected)::bigint corrected, (select count(*) from corrections)::bigint as corrections, round((select count(*) from items where is_corrected) / (select count(*) from items), 4) rate, least(500, (select count(*) from items where not is_corrected))::bigint queue_depth")
def agg_23(t: Tables) -> DataFrame:
    depth = items(t).where(~F.col("is_corrected")).limit(500).agg(F.count("*").alias("queue_depth"))
    return o.correction_stats(items(t), corrections(t)).crossJoin(depth)


def _fired(t: Tables) -> DataFrame:
    f = facts(t)
    visit = F.concat_ws("-", F.col("patient_id").cast("string"), F.col("day").cast("string"))
    return f.select(visit.alias("visit_id"), F.col("code").alias("dedupe_key"), F.col("event_id").alias("seq"), F.when(F.col("value") > 50, "critical").otherwise("info").alias("severity"), F.concat(F.lit("seen "), "code").alias("title"), F.array(F.col("event_id").cast("string"), "code").alias("evidence"), F.array((F.floor("value") % 3).cast("string")).alias("tests"))


@query("agg_26", f"""with {FACTS}, r as (select patient_id || '-' || day visit_id, code dedupe_key, event_id seq, case when value > 50 then 'critical' else 'info' end severity, 'seen ' || code title, event_id::varchar e, code, (floor(value)::bigint % 3)::varchar te, 'at ' || floor(value)::bigint % 4 ch, 'page ' || event_id % 5 re from facts)
  select visit_id, dedupe_key, arg_min(severity, seq) severity, arg_min(title, seq) title, list_sort(list_distinct(list_concat(list(e), list(code)))) evidence, list_sort(list_distinct(list(te))) tests, list_sort(list_distinct(list(ch))) as chain, list_sort(list_distinct(list(re))) as "references" from r group by 1, 2""")
def agg_26(t: Tables) -> DataFrame:
    more = facts(t).select(F.col("event_id").alias("seq"), F.array(F.concat(F.lit("at "), (F.floor("value") % 4).cast("string"))).alias("chain"), F.array(F.concat(F.lit("page "), (F.col("event_id") % 5).cast("string"))).alias("references"))
    return o.merge_suggestions(_fired(t).join(more, "seq"), ("evidence", "tests", "chain", "references"))


@query("agg_27", f"""with {FACTS}, f as (select patient_id || '-' || day visit_id, * from facts), r as (select distinct visit_id from f where code = 'error')
  select visit_id, 'R-ERR' rule_id, list_sort(list(event_id)) evidence from r join f using (visit_id) where code in ('error', 'click') group by 1""")
def agg_27(t: Tables) -> DataFrame:
    from visitloom.operators.rules import rule_evidence

    visit = F.concat_ws("-", F.col("patient_id").cast("string"), F.col("day").cast("string"))
    rows = facts(t).withColumn("visit_id", visit).withColumn("fact_id", F.col("event_id"))
    fired = rows.where("code = 'error'").select("visit_id").distinct().select("visit_id", F.lit("R-ERR").alias("rule_id"), F.array(F.lit("error"), F.lit("click")).alias("codes"))
    return rule_evidence(fired, rows)


@query("agg_28", f"with {FACTS} select patient_id || '-' || day visit_id, arg_max(value, seen_at) as value from facts where code = 'view' group by 1")
def agg_28(t: Tables) -> DataFrame:
    visit = F.concat_ws("-", F.col("patient_id").cast("string"), F.col("day").cast("string"))
    rows = facts(t).select(visit.alias("visit_id"), "code", F.col("value").cast("string").alias("value"), F.col("seen_at").alias("report_index"), F.col("event_id").alias("item_pos"))
    return o.latest_numeric(rows, "view")


@query("agg_29", f"with {FACTS} select patient_id || '-' || day visit_id, list_sort(list_distinct(list(code))) codes from facts where not negated group by 1")
def agg_29(t: Tables) -> DataFrame:
    from visitloom.operators.rules import present_codes

    visit = F.concat_ws("-", F.col("patient_id").cast("string"), F.col("day").cast("string"))
    return present_codes(facts(t).withColumn("visit_id", visit))


@query("agg_31", f"""with {FACTS}, p as (select patient_id, code, day, min(event_id) fact_id from facts where not negated group by all)
  select patient_id, code, count(*)::bigint visits, list_sort(list(fact_id)) evidence from p group by 1, 2 having count(*) >= 2""")
def agg_31(t: Tables) -> DataFrame:
    return o.persistent(facts(t).withColumn("visit_id", F.col("day")).withColumn("fact_id", F.col("event_id")))


@query("agg_32", f"""with {FACTS}, e as (select patient_id, code, arg_min(value, seen_at) as first, arg_max(value, seen_at) as last, arg_min(event_id, seen_at) first_id, arg_max(event_id, seen_at) last_id, count(*)::bigint n from facts where value <> 0 group by 1, 2)
  select *, round(round(last - first, 6), 1) rise from e where n >= 2 and last - first >= 10""")
def agg_32(t: Tables) -> DataFrame:
    return o.worsening(facts(t).withColumnRenamed("seen_at", "at").withColumn("fact_id", F.col("event_id")))


@query("agg_33", f"""with {STATES}, s as (select patient_id || '-' || effective_at::date visit_id, * from states)
  select visit_id, case when bool_or(pregnant) or count(ga_weeks) > 0 then true when bool_or(not pregnant) then false end pregnant, coalesce(bool_or(postpartum), false) postpartum,
  arg_min(ga_weeks, event_id) filter (where ga_weeks is not null) as week from s group by 1""")
def agg_33(t: Tables) -> DataFrame:
    visit = F.concat_ws("-", F.col("patient_id").cast("string"), F.to_date("effective_at").cast("string"))
    return o.detect_context(states(t).select(visit.alias("visit_id"), "pregnant", "postpartum", F.col("ga_weeks").alias("week"), F.col("event_id").alias("pos")))


@query("agg_37", f"""with {SEGMENTS}, k as (select distinct job_id, unnest(['user', 'assistant', 'system', 'tool']) section from segments), g as (select job_id, speaker section, list(text order by order_index, text) texts from segments group by 1, 2)
  select job_id, section, coalesce(texts, []) texts from k left join g using (job_id, section)""")
def agg_37(t: Tables) -> DataFrame:
    return o.sections(segments(t).withColumnRenamed("speaker", "section"), ["user", "assistant", "system", "tool"])


@query("agg_38", f"""with {ITEMS}, r as (select job_id, label section, order_index, trim('part ' || code % 7) as text, item_id from items),
  f as (select *, row_number() over (partition by job_id, section, lower(text) order by order_index) n from r)
  select job_id, section, string_agg(text, '; ' order by order_index) filter (where n = 1) paragraph, list(item_id order by order_index) item_ids from f group by 1, 2""")
def agg_38(t: Tables) -> DataFrame:
    return o.section_text(items(t).select("job_id", F.col("label").alias("section"), "order_index", F.concat(F.lit("part "), (F.col("code") % 7).cast("string")).alias("text"), "item_id"))


@query("agg_40", f"""with {CORRECTIONS}, r as (select case when is_suspect then 'suspect' when is_corrected then 'corrected' when confidence < 0.5 then 'confidence' when ood > 0.4 then 'ood' else 'accepted' end reason from items)
  select reason, count(*)::bigint n from r group by 1""")
def agg_40(t: Tables) -> DataFrame:
    from visitloom.operators.curation import rejection

    return items(t).groupBy(rejection(0.5, 0.4).alias("reason")).agg(F.count("*").alias("n"))


@query("agg_41", """with w as (select doc_id id, regexp_extract_all(lower(text), '\\p{L}{2,}') w from documents), s as (select id, w, unnest([2, 3, 4]) n from w),
  g as (select id, unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i + 1:i + n], ' '))) phrase from s where len(w) >= n),
  c as (select phrase, string_split(phrase, ' ') g, count(*) n, min(id) example from g group by all having count(*) >= 8),
  k as (select * from c where not (g[1] in ('the', 'of', 'and') and g[len(g)] in ('the', 'of', 'and')) and len(list_filter(g, lambda x: x not in ('the', 'of', 'and'))) > 0),
  h as (select phrase, array_to_string(g[x:x + m - 1], ' ') form from (select phrase, g, unnest([1, 2, 3, 4]) m from k), range(1, 5) t(x) where x + m - 1 <= len(g)),
  f as (select distinct lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) form from benchmark),
  o as (select * from k where phrase not in (select phrase from h join f using (form)))
  select phrase, n::bigint n, example from o where phrase not in (select form from h where form <> phrase and phrase in (select phrase from o)) order by n desc, phrase limit 100""")
def agg_41(t: Tables) -> DataFrame:
    """Known forms: the first two words of each benchmark passage."""
    w = F.split("text", " ")
    known = t.benchmark.select(F.concat_ws(" ", F.get(w, F.lit(0)), F.coalesce(F.get(w, F.lit(1)), F.lit(""))).alias("phrase"))
    return mine_phrases(t.documents.select(F.col("doc_id").alias("id"), "text"), ["the", "of", "and"], 8, 100, known)


@query("agg_42", "with n as (select quality as label, count(*)::bigint n from labels group by 1) select label, n, round(1 / n / (select sum(1 / n) from n) * (select count(*) from n), 6) weight from n")
def agg_42(t: Tables) -> DataFrame:
    return o.class_weights(t.labels, "quality")


@query("agg_42_source", "select doc_id, case doc_id % 6 when 0 then 3 when 1 then 2 when 2 then 0.5 when 3 then 1 when 4 then 1 else 3 end::double weight from documents")
def agg_42_source(t: Tables) -> DataFrame:
    """Sources by the documents' number; pseudo labels weigh more than by default."""
    source = F.get(F.array(*[F.lit(x) for x in ("human", "confirmed", "pseudo", "synthetic", "odd", None)]), (F.col("doc_id") % 6).cast("int"))
    return t.documents.select("doc_id", o.source_weight(source, {"pseudo": 0.5}).alias("weight"))


@query("agg_43", "select lang as label, (row_number() over (order by lang) - 1)::int id from (select distinct lang from documents where lang is not null)")
def agg_43(t: Tables) -> DataFrame:
    return o.label_ids(t.documents, "lang")
