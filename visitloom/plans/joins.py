"""Queries of joins and states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.operators import linkage as o
from visitloom.operators import rules as r
from visitloom.operators import states as st
from visitloom.plans.bindings import FACTS, ITEMS, JOBS, SEGMENTS, STATES, facts, items, jobs, segments, states
from visitloom.plans.registry import Tables, query
from visitloom.plans.rows import CORRECTIONS, corrections

VISIT = "patient_id || '-' || day visit_id"


def visit_facts(t: Tables) -> DataFrame:
    return facts(t).withColumn("visit_id", F.concat_ws("-", F.col("patient_id").cast("string"), F.col("day").cast("string"))).withColumn("fact_id", F.col("event_id"))


VFACTS = f"{FACTS}, vf as (select {VISIT}, event_id fact_id, * from facts)"


@query("join_01", f"""with {JOBS}, {ITEMS}, l as (select job_id, label, count(*) k from items group by all),
  r as (select job_id, count(*)::bigint n_items, round(avg(confidence), 4) avg_confidence from items group by 1), p as (select job_id, list(label order by k desc, label)[1:5] top_labels from l group by 1)
  select job_id, patient_id, c_name patient, visit_at clinical_at, coalesce(n_items, 0)::bigint n_items, coalesce(avg_confidence, 0) avg_confidence, coalesce(top_labels, []) top_labels
  from jobs left join customer on c_custkey = patient_id left join r using (job_id) left join p using (job_id)""")
def join_01(t: Tables) -> DataFrame:
    visits = t.customer.select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("patient"))
    return o.patient_timeline(jobs(t), items(t), visits).orderBy(F.col("clinical_at").desc(), "job_id")


@query("join_02", f"""with {JOBS} select a.job_id, coalesce((list(b.job_id order by b.visit_at, b.job_id) filter (where b.job_id is not null))[-3:], []) history
  from jobs a left join jobs b on a.patient_id = b.patient_id and b.status = 'complete' and b.visit_at < a.visit_at group by 1""")
def join_02(t: Tables) -> DataFrame:
    return st.recent_history(jobs(t), 3)


@query("join_03", f"with {CORRECTIONS} select job_id, item_id, old_value, new_value, created_at, text from corrections join items using (item_id, job_id)")
def join_03(t: Tables) -> DataFrame:
    return corrections(t).join(items(t).select("item_id", "job_id", "text"), ["item_id", "job_id"]).select("job_id", "item_id", "old_value", "new_value", "created_at", "text").orderBy("created_at", "item_id")


@query("join_04", "select doc_id from documents where text not in (select text from documents join labels using (doc_id) where toxic = 1)")
def join_04(t: Tables) -> DataFrame:
    bad = t.documents.join(t.labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    return o.drop_corrected(t.documents.select("doc_id", "text"), bad).select("doc_id")


@query("join_05", f"with {CORRECTIONS} select item_id, item_id in (select item_id from corrections) is_error from items")
def join_05(t: Tables) -> DataFrame:
    return o.flag_errors(items(t).select("item_id"), corrections(t))


WINDOWS = dict(term=12, grace=2, after=5)
OBSERVED = f"""{STATES}, obs as (select *, case when postpartum then 'postpartum' when coalesce(pregnant, false) then 'pregnant' else 'unknown' end status,
  case when postpartum then effective_at + interval 5 day when coalesce(pregnant, false) then effective_at + to_days(12 - 7 * coalesce(ga_weeks, 20)) + interval 2 day end expires_at,
  case when not postpartum and coalesce(pregnant, false) then effective_at + to_days(12 - 7 * coalesce(ga_weeks, 20)) end edd
  from states where pregnant is not null or postpartum or ga_weeks is not null)"""


def observed(t: Tables) -> DataFrame:
    return st.state_observation(states(t), **WINDOWS).withColumn("created_at", F.col("effective_at"))


@query("join_06", f"""with {OBSERVED}, m as (select event_id moment_id, patient_id, effective_at as t from states where kind in ('view', 'click')),
  j as (select m.*, o.status s, o.expires_at x, o.ga_weeks w, o.effective_at e from m asof left join obs o on m.patient_id = o.patient_id and m.t >= o.effective_at),
  r as (select *, coalesce(t > x, false) expired, case when s is null or t > x then 'unknown' else s end status from j)
  select patient_id, moment_id, t as "at", status, expired, case when status = 'pregnant' and w + floor(date_diff('day', e::date, t::date) / 7) between 1 and 45 then (w + floor(date_diff('day', e::date, t::date) / 7))::int end as weeks from r""")
def join_06(t: Tables) -> DataFrame:
    moments = states(t).where("kind in ('view', 'click')").select("patient_id", F.col("event_id").alias("moment_id"), F.col("effective_at").alias("at"))
    return st.state_as_of(observed(t), moments)


TIMED = """s as (select job_id recording, order_index seg, speaker, text, order_index * 10.0 as start, order_index * 10.0 + 4 + length(text) % 17 as stop from segments),
  t as (select job_id recording, order_index turn, speaker as cluster, order_index * 10.0 + 3 from_, order_index * 10.0 + 12 to_ from segments)"""


def timed(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = segments(t)
    start = F.col("order_index") * 10.0
    s = rows.select(F.col("job_id").alias("recording"), F.col("order_index").alias("seg"), "text", start.alias("start"), (start + 4 + F.length("text") % 17).alias("end"))
    turns = rows.select(F.col("job_id").alias("recording"), F.col("order_index").alias("turn"), F.col("speaker").alias("cluster"), (start + 3).alias("from_"), (start + 12).alias("to_"))
    return s, turns


BEST = """b as (select s.recording, seg, s.text, arg_max(cluster, (least(stop, to_) - greatest(start, from_), -turn)) filter (where least(stop, to_) - greatest(start, from_) > 0) as cluster,
  round(max(least(stop, to_) - greatest(start, from_)) filter (where least(stop, to_) - greatest(start, from_) > 0), 4) overlap from s left join t on s.recording = t.recording group by 1, 2, 3)"""


@query("join_07", f"with {SEGMENTS}, {TIMED}, {BEST} select recording, seg, cluster, overlap::double as \"overlap\" from b")
def join_07(t: Tables) -> DataFrame:
    return o.assign_turn(*timed(t))


@query("join_08", f"with {SEGMENTS}, {TIMED}, {BEST} select recording, cluster, string_agg(text, ' ' order by seg) as text from b where cluster is not null group by 1, 2")
def join_08(t: Tables) -> DataFrame:
    s, turns = timed(t)
    assigned = o.assign_turn(s, turns).where("cluster is not null")
    return o.cluster_texts(assigned.join(s.select("recording", "seg", "text"), ["recording", "seg"]))


@query("join_09", f"""with {ITEMS}, f as (select job_id visit_id, p_brand family, label from items join part on p_partkey = code)
  select visit_id, family, count(*) filter (where label = 'R')::bigint allergies, count(*) filter (where label = 'N')::bigint medications, (count(*) filter (where label = 'R') * count(*) filter (where label = 'N'))::bigint pairs from f group by 1, 2 having allergies > 0 and medications > 0""")
def join_09(t: Tables) -> DataFrame:
    family = t.part.select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("family"))
    kinds = F.when(F.col("label") == "R", "allergy").when(F.col("label") == "N", "medication")
    return o.family_conflicts(items(t).join(family, "code").select(F.col("job_id").alias("visit_id"), "family", kinds.alias("kind")))


@query("join_10", f"with {VFACTS} select visit_id from vf group by 1 having bool_or(code = 'view') and bool_or(code = 'purchase' and value >= 20)")
def join_10(t: Tables) -> DataFrame:
    return r.all_of(visit_facts(t), {"seen": r.has("view"), "bought": r.has("purchase", F.col("value") >= 20)})


@query("join_11", f"with {VFACTS} select visit_id from vf group by 1 having not bool_or(code = 'error') and not bool_or(code = 'signup')")
def join_11(t: Tables) -> DataFrame:
    return r.none_of(visit_facts(t), {"error": r.has("error"), "signup": r.has("signup")})


def edges(t: Tables) -> DataFrame:
    """Edges that a graph of regions and nations has: a region requires its nations; nation n satisfies n + 1."""
    a = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("source"), F.lit("requires").alias("relation"), F.col("n_name").alias("target"), F.lit(None).cast("int").alias("validity_days"))
    b = t.nation.select(F.col("n_name").alias("source"), F.lit("satisfies").alias("relation"), F.concat(F.lit("NATION_"), (F.col("n_nationkey") + 1).cast("string")).alias("target"), F.lit(None).cast("int").alias("validity_days"))
    c = t.nation.select(F.col("n_name").alias("source"), F.lit("valid_for").alias("relation"), F.lit(None).cast("string").alias("target"), (F.col("n_nationkey") * 100).cast("int").alias("validity_days"))
    return a.unionByName(b).unionByName(c)


@query("join_12", """with c as (select s_suppkey visit_id, r_name condition from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
  d as (select s_suppkey visit_id, n_name test from supplier join nation on s_nationkey = n_nationkey), w as (select visit_id, r_name condition, n_name test from c join region on r_name = condition join nation on n_regionkey = r_regionkey)
  select visit_id, condition, list_sort(list(distinct test)) missing from w where (visit_id, test) not in (select visit_id, test from d) group by 1, 2""")
def join_12(t: Tables) -> DataFrame:
    home = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return o.missing_tests(home.select(F.col("s_suppkey").alias("visit_id"), F.col("r_name").alias("condition")), edges(t), home.select(F.col("s_suppkey").alias("visit_id"), F.col("n_name").alias("test")))


@query("join_13", "select r_name source from nation join region on n_regionkey = r_regionkey where n_name = 'NATION_7'")
def join_13(t: Tables) -> DataFrame:
    return o.edge_sources(edges(t), "requires", "NATION_7")


@query("join_14", """with d as (select o_orderkey visit_id, o_custkey % 25 k, o_orderdate::date done from orders), e as (select visit_id, k test, done, k src from d union all select visit_id, k + 1, done, k from d)
  select distinct visit_id, 'NATION_' || test as test from e where date_diff('day', done, date '1999-01-01') <= src * 100""")
def join_14(t: Tables) -> DataFrame:
    done = t.orders.select(F.col("o_orderkey").alias("visit_id"), F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string")).alias("test"), F.to_date("o_orderdate").alias("done_at"))
    return o.valid_tests(done, edges(t), F.lit("1999-01-01").cast("date"))


@query("join_15", """with m as (select doc_id id, text, source as label from documents), d as (select min(doc_id) doc_id, max(quality) q from labels group by labels.doc_id),
  x as (select distinct text, 'checked' decision from documents join d using (doc_id) where q = 0), f as (select id, m.text, coalesce(decision, case label when 'src1' then 'src2' else label end) as label from m left join x using (text))
  select min(id) id, md5(text) text, label from f group by f.text, label""")
def join_15(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("label"))
    merges = t.documents.select(F.col("source").alias("old")).where("old = 'src1'").distinct().withColumn("new", F.lit("src2"))
    poor = t.labels.groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 0")
    decisions = t.documents.join(poor, "doc_id", "left_semi").select("text").distinct().withColumn("decision", F.lit("checked"))
    return o.apply_decisions(rows, merges, decisions).withColumn("text", F.md5("text"))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query("join_17", """with e as (select vec_id id, embedding::double[] v from embeddings), p as (select a.id, b.id n, round(list_cosine_similarity(a.v, b.v), 9) c from e a join e b on a.id <> b.id)
  select id, arg_max(n, (c, -n)) neighbour, max(c) cosine from p group by 1""")
def join_17(t: Tables) -> DataFrame:
    rows = vectors(t)
    return o.nearest(rows)


@query("join_18", "with e as (select vec_id id, embedding::double[] v from embeddings), s as (select * from e where id = 0) select s.id seed_id, e.id, round(list_cosine_similarity(s.v, e.v), 6) cosine from e, s where e.id <> 0 order by cosine desc, e.id limit 25")
def join_18(t: Tables) -> DataFrame:
    return o.neighbours(vectors(t).where("id = 0"), vectors(t), 25)


MEANS = "d as (select label, generate_subscripts(embedding, 1) i, unnest(embedding::double[]) x from embeddings), m as (select label, i, avg(x) x from d group by 1, 2), c as (select label, list(x order by i) p from m group by 1)"


def class_means(t: Tables) -> DataFrame:
    long = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("p"))


@query("join_19", f"with {MEANS}, s as (select vec_id id, label, round(list_cosine_similarity(embedding::double[], p), 6) s from embeddings e, c) select id, arg_max(label, (s, -label)) as label, max(s) similarity from (select vec_id id, c.label, round(list_cosine_similarity(embedding::double[], p), 6) s from embeddings, c) group by 1".replace(", s as (select vec_id id, label, round(list_cosine_similarity(embedding::double[], p), 6) s from embeddings e, c)", ""))
def join_19(t: Tables) -> DataFrame:
    return o.best_prototype(vectors(t).select("id", "v"), class_means(t))


@query("join_21", f"""with {VFACTS}, l as (select distinct visit_id, code from vf where fact_id % 2 = 0), x as (select distinct visit_id, code from vf where fact_id % 2 = 1), w as (select visit_id, code from l union select visit_id, 'click' from l where code = 'view')
  select visit_id, code, 'link' origin from l union all select visit_id, code, 'text' from x where (visit_id, code) not in (select visit_id, code from w)""")
def join_21(t: Tables) -> DataFrame:
    f = visit_facts(t)
    parents = f.where("code = 'view'").select(F.col("code").alias("parent"), F.lit("click").alias("child")).distinct()
    return o.supplement_facts(f.where("fact_id % 2 = 0").select("visit_id", "code").distinct(), f.where("fact_id % 2 = 1").select("visit_id", "code").distinct(), parents)


@query("join_22", f"""with {VFACTS}, f as (select distinct visit_id, 'R-' || code rule_id from vf), m as (select distinct visit_id, 'R-view' rule_id from vf), n as (select distinct visit_id, 'R-error' rule_id from vf where value > 50)
  select *, 'missing' problem from m where (visit_id, rule_id) not in (select visit_id, rule_id from f) union all select *, 'forbidden' from n where (visit_id, rule_id) in (select visit_id, rule_id from f) union all select *, 'leaked' from f where starts_with(rule_id, 'R-sig')
  union all select visit_id, 'R-c', 'absent' from (select distinct visit_id from vf) v where not exists (select 1 from f where f.visit_id = v.visit_id and starts_with(f.rule_id, 'R-c'))""")
def join_22(t: Tables) -> DataFrame:
    f = visit_facts(t)
    fired = f.select("visit_id", F.concat(F.lit("R-"), "code").alias("rule_id")).distinct()
    prefixes = f.where("code = 'signup'").select(F.lit("R-sig").alias("prefix")).distinct()
    return o.check_rules(fired, f.select("visit_id", F.lit("R-view").alias("rule_id")).distinct(), f.where("value > 50").select("visit_id", F.lit("R-error").alias("rule_id")).distinct(), prefixes, f.select("visit_id", F.lit("R-c").alias("prefix")).distinct())


@query("join_23", f"with {ITEMS}, b as (select label as name, round(avg(confidence), 6) score from items group by 1), c as (select label as name, round(avg(confidence + ood / 10), 6) score from items group by 1) select name, b.score \"before\", c.score \"after\", round((c.score - b.score) * 100, 4) gain, round((c.score - b.score) * 100, 4) >= 1.5 passes from b join c using (name)")
def join_23(t: Tables) -> DataFrame:
    rows = items(t).groupBy(F.col("label").alias("name"))
    return o.compare_runs(rows.agg(F.round(F.avg("confidence"), 6).alias("score")), rows.agg(F.round(F.avg(F.col("confidence") + F.col("ood") / 10), 6).alias("score")), 1.5)


@query("join_24", f"with {JOBS} select job_id, c_name patient, case when status = 'complete' then visit_at + interval 1 day end finalized_at from jobs left join customer on c_custkey = patient_id")
def join_24(t: Tables) -> DataFrame:
    finals = jobs(t).where("status = 'complete'").select("job_id", (F.col("visit_at") + F.expr("interval 1 day")).alias("finalized_at"))
    names = t.customer.select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("patient"))
    return jobs(t).join(names, "patient_id", "left").join(finals, "job_id", "left").select("job_id", "patient", "finalized_at")


@query("join_25", f"with {JOBS} select job_id, case when job_id % 3 = 0 then 'audio/' || job_id || '.wav' end path, case when job_id % 3 = 0 then 'imported' else 'no_file' end outcome from jobs where status <> 'complete'")
def join_25(t: Tables) -> DataFrame:
    every = jobs(t)
    files = every.where("job_id % 3 = 0").select(F.concat(F.lit("audio/"), F.col("job_id").cast("string"), F.lit(".wav")).alias("path"))
    return o.backfill(every.select("job_id"), every.where("status = 'complete'"), files)


@query("win_13", f"with {OBSERVED} select event_id, case when status = 'pregnant' and ga_weeks + floor(date_diff('day', effective_at::date, date '2024-02-15') / 7) between 1 and 45 then (ga_weeks + floor(date_diff('day', effective_at::date, date '2024-02-15') / 7))::int end as weeks from obs")
def win_13(t: Tables) -> DataFrame:
    return observed(t).select("event_id", st.ga_weeks_at(F.col("status"), F.col("ga_weeks"), F.col("effective_at"), F.lit("2024-02-15").cast("date")).alias("weeks"))


@query("win_14", f"with {OBSERVED} select patient_id, list(status order by effective_at, status) history, count(*)::bigint n from obs group by 1")
def win_14(t: Tables) -> DataFrame:
    return st.state_history(observed(t))


@query("dat_01", f"with {STATES} select event_id, case when ga_weeks <= 13 then 1 when ga_weeks <= 27 then 2 when ga_weeks is not null then 3 end trimester from states")
def dat_01(t: Tables) -> DataFrame:
    return states(t).select("event_id", st.trimester(F.col("ga_weeks")).alias("trimester"))


@query("dat_02", f"with {OBSERVED} select event_id, status, edd, expires_at from obs")
def dat_02(t: Tables) -> DataFrame:
    return observed(t).select("event_id", "status", "edd", "expires_at")


@query("dat_03", f"with {OBSERVED} select event_id, coalesce(timestamp '2024-01-15' > expires_at, false) expired from obs")
def dat_03(t: Tables) -> DataFrame:
    return observed(t).select("event_id", st.is_expired(F.col("expires_at"), F.lit("2024-01-15").cast("timestamp")).alias("expired"))


@query("upd_07", f"with {OBSERVED}, n as (select * from obs union all select * replace ('unknown' as status) from obs where event_id % 5 = 0) select patient_id, count(*)::bigint n, count(*) filter (where status = 'unknown')::bigint unknowns from n group by 1")
def upd_07(t: Tables) -> DataFrame:
    old = observed(t)
    revised = old.where("event_id % 5 = 0").withColumn("status", F.lit("unknown")).withColumn("created_at", F.col("created_at") + F.expr("interval 1 hour"))
    return st.append_state(old, revised).groupBy("patient_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "unknown").alias("unknowns"))


@query("agg_35", f"""with {OBSERVED}, v as (select event_id visit_id, lag(status) over w ps, lag(effective_at) over w pa, lag(ga_weeks) over w pw, event_id % 2 = 0 ex, pregnant, postpartum, ga_weeks w, effective_at at_ from obs window w as (partition by patient_id order by effective_at, event_id)),
  s as (select *, case when coalesce(ex and abs(epoch(date_trunc('second', at_)) - epoch(date_trunc('second', pa))) <= 60 and ps is not null, false) then ps else coalesce(case when postpartum then 'postpartum' when pregnant then 'pregnant' when not pregnant then 'unknown' end, ps, 'unknown') end status from v),
  f as (select *, coalesce(w, case when status = 'pregnant' and pw + floor(date_diff('day', pa::date, at_::date) / 7) between 1 and 45 then (pw + floor(date_diff('day', pa::date, at_::date) / 7))::int end) wk from s)
  select visit_id, status, case when status = 'pregnant' then wk end as weeks, case when status = 'pregnant' then case when wk <= 13 then 1 when wk <= 27 then 2 when wk is not null then 3 end end trimester from f""")
def agg_35(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("patient_id").orderBy("effective_at", "event_id")
    prior = observed(t).select(F.col("event_id").alias("visit_id"), F.col("effective_at").alias("at"), F.lag("status").over(w).alias("prior_status"), F.when(F.col("event_id") % 2 == 0, "explicit").otherwise("text").alias("prior_source"), F.lag("effective_at").over(w).alias("prior_at"), F.lag("ga_weeks").over(w).alias("prior_weeks"), "pregnant", "postpartum", F.col("ga_weeks").alias("week"))
    return st.effective_context(prior)
