"""Queries over vectors and confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.operators import aggregates as ag
from visitloom.operators import clusters as cl
from visitloom.operators import linkage as li
from visitloom.operators import vectors as o
from visitloom.plans.joins import MEANS, class_means, vectors
from visitloom.plans.files import scratch
from visitloom.plans.registry import Tables, query

LOGITS = f"""{MEANS}, g as (select vec_id id, e.label gold, list(round(-list_sum(list_transform(list_zip(embedding::double[], p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) order by c.label) x from embeddings e, c group by vec_id, e.label),
  b as (select *, list_transform(x, lambda v: exp(v - list_max(x))) ex from g), pred as (select id, gold, (list_position(x, list_max(x)) - 1)::int pred, round(1 / list_sum(ex), 9) conf, list_position(x, list_max(x)) - 1 = gold hit, ex[gold + 1] / list_sum(ex) p_gold from b)"""


def _pred(t: Tables) -> DataFrame:
    return o.predicted(o.logits(vectors(t), class_means(t)))


REPORT = """cl as (select gold l from pred union select pred from pred), rp as (select l as label, count(*) filter (where pred = l) said, count(*) filter (where gold = l) support, count(*) filter (where gold = l and pred = l) hits from pred, cl group by 1),
  report as (select label, round(case when said > 0 then hits / said else 0 end, 6) as "precision", round(case when support > 0 then hits / support else 0 end, 6) recall, round(case when hits > 0 then 2 * hits / (said + support) else 0 end, 6) f1, support::bigint support from rp)"""


@query("agg_09", f"with {LOGITS}, {REPORT} select * from report")
def agg_09(t: Tables) -> DataFrame:
    return ag.classification_report(_pred(t))


@query("agg_09_overall", f"with {LOGITS}, {REPORT} select round(avg(f1), 5) macro_f1, round(sum(f1 * support) / sum(support), 5) weighted_f1, (select round(count(*) filter (where hit) / count(*), 5) from pred) accuracy from report")
def agg_09_overall(t: Tables) -> DataFrame:
    pred = _pred(t)
    return ag.overall(ag.classification_report(pred), pred)


@query("agg_10", f"with {LOGITS}, bn as (select ceil(conf * 15) k, count(*) n, avg(conf) c, avg(hit::int) h from pred group by 1) select round(sum(case when k > 0 then n * abs(c - h) else 0 end) / sum(n), 6) ece from bn")
def agg_10(t: Tables) -> DataFrame:
    return ag.ece(_pred(t))


@query("agg_11", f"with {LOGITS} select round(avg(-ln(greatest(p_gold, 1e-12))), 6) nll from pred")
def agg_11(t: Tables) -> DataFrame:
    return _pred(t).agg(ag.nll(F.col("p_gold")).alias("nll"))


@query("agg_12")
def agg_12(t: Tables) -> DataFrame:
    path = scratch(t, "logits")
    o.logits(vectors(t), class_means(t)).write.parquet(path)
    return o.calibrate(t.spark.read.parquet(path))


@query("agg_13", f"""with {LOGITS}, k as (select floor(conf * 1000) / 1000 cut, count(*) k, sum(hit::int) h from pred group by 1), s as (select cut, sum(k) over (order by cut desc) n, sum(h) over (order by cut desc) g, sum(k) over () a from k)
  select max(cut) threshold from s where g >= 0.9 * n and n >= 0.3 * a""")
def agg_13(t: Tables) -> DataFrame:
    return ag.threshold_for_precision(_pred(t))


@query("agg_14", """with s as (select n_chars score, toxic = 1 pos from documents join (select doc_id, max(toxic) toxic from labels group by 1) using (doc_id) where toxic is not null), g as (select score, count(*) filter (where pos) p, count(*) filter (where not pos) n from s group by 1),
  w as (select p, n, p * (coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) + n / 2) won from g) select round(sum(won) / (sum(p) * sum(n)), 8) auroc from w""")
def agg_14(t: Tables) -> DataFrame:
    marks = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    return ag.auroc(t.documents.join(marks, "doc_id").select(F.col("n_chars").alias("score"), (F.col("toxic") == 1).alias("positive")))


STATS = """d as (select vec_id, label, generate_subscripts(embedding, 1) i, unnest(embedding::double[]) x from embeddings), pm as (select label, i, avg(x) m, count(*) n, sum(x * x) s from d group by 1, 2),
  wi as (select i, sum(s - n * m * m) / (sum(n) - 1) v from pm group by 1), tg as (select quantile_cont(v, 0.5) t from wi where v > 0), sh as (select i, greatest(0.999 * v + 0.001 * t, 1e-6 * t, 1e-12) v from wi, tg),
  ds as (select vec_id id, d.label, pm.label c, sqrt(sum((x - m) * (x - m) / v)) g from d join pm using (i) join sh using (i) group by 1, 2, 3)"""


@query("agg_15", f"with {STATS} select pm.label, n::bigint n, round(avg(m), 8) mean, round(avg(v), 8) variance from pm join sh using (i) group by 1, 2")
def agg_15(t: Tables) -> DataFrame:
    def mean(c: str):
        return F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c), 8)

    return o.class_stats(vectors(t)).select("label", "n", mean("mean").alias("mean"), mean("variance").alias("variance"))


@query("join_20", f"with {STATS} select id, label, round(min(g), 6) distance, arg_min(c, g) nearest from ds group by 1, 2")
def join_20(t: Tables) -> DataFrame:
    return o.class_distance(vectors(t), o.class_stats(vectors(t)))


@query("agg_16", f"with {STATS}, m as (select id, round(min(g), 6) g from ds group by 1) select round(quantile_cont(g, 0.5), 6) p5, round(quantile_cont(g, 0.9), 6) p9, round(quantile_cont(g, 0.95), 6) p95, round(quantile_cont(g, 0.99), 6) p99, round(quantile_cont(g, 0.995), 6) p995 from m")
def agg_16(t: Tables) -> DataFrame:
    return o.distance_quantiles(o.class_distance(vectors(t), o.class_stats(vectors(t))))


@query("agg_17", """with s as (select vec_id id, unnest(range(4)) pass, embedding::double[] e from embeddings), q as (select id, pass, unnest(range(len(e) // 4))::int class, e from s), p as (select id, pass, class, round(abs(e[pass * (len(e) // 4) + class + 1]), 6) p from q),
  v as (select id, class, var_pop(p) v, avg(p) m from p group by 1, 2), a as (select id, round(avg(v), 8) variance, round(max(m), 8) confidence from v group by 1), w as (select id, pass, arg_max(class, (p, -class)) vote from p group by 1, 2), k as (select id, vote, count(*) k from w group by 1, 2)
  select id, variance, confidence, round(1 - max(k) / sum(k), 6) disagreement from a join k using (id) group by 1, 2, 3""")
def agg_17(t: Tables) -> DataFrame:
    """A vector's components as four passes over as many classes as a quarter of them."""
    long = t.embeddings.select(F.col("vec_id").alias("id"), F.floor(F.size("embedding") / 4).cast("int").alias("w"), F.posexplode("embedding").alias("i", "x"))
    return o.mc_stats(long.select("id", F.floor(F.col("i") / F.col("w")).alias("pass"), (F.col("i") % F.col("w")).alias("class"), F.round(F.abs(F.col("x").cast("double")), 6).alias("p")))


@query("vec_04")
def vec_04(t: Tables) -> DataFrame:
    return cl.link_clusters(vectors(t), "label")


@query("agg_25")
def agg_25(t: Tables) -> DataFrame:
    """Labels as owners; a fifth of the vectors in each recording."""
    rows = vectors(t).select(F.col("label").alias("owner"), "id", "v", (F.col("id") % 5).alias("recording"))
    return cl.speaker_profile(rows).withColumn("prototype", F.transform("prototype", lambda x: F.round(x, 6)))


@query("agg_45", """with e as (select vec_id id, label, embedding::double[] v from embeddings where label in (1, 2)), p as (select a.id, a.label l, b.label o, b.id bi, round(list_cosine_similarity(a.v, b.v), 9) c from e a join e b on a.id <> b.id), n as (select id, l, arg_max(o, (c, -bi)) o from p group by 1, 2)
  select round(avg((l = o)::int), 6) purity, case when round(avg((l = o)::int), 6) >= 0.8 then 'separable' when round(avg((l = o)::int), 6) >= 0.6 then 'weak' else 'not separable' end band from n""")
def agg_45(t: Tables) -> DataFrame:
    rows = vectors(t).where("label in (1, 2)")
    near = li.nearest(rows)
    own = rows.select("id", "label")
    joined = near.join(own, "id").join(own.select(F.col("id").alias("neighbour"), F.col("label").alias("other")), "neighbour")
    return o.separability(joined, 1, 2)


@query("mth_06")
def mth_06(t: Tables) -> DataFrame:
    return o.mahalanobis(vectors(t))


@query("vec_01")
def vec_01(t: Tables) -> DataFrame:
    return o.char_tfidf(t.documents.select(F.col("doc_id").alias("id"), "text"))


@query("vec_02")
def vec_02(t: Tables) -> DataFrame:
    every = None
    for r in vectors(t).select("label").where("label is not null").distinct().orderBy("label").collect():  # a row per class
        one = o.cluster_label(vectors(t).where(F.col("label") == r["label"]), 4).select("id", F.lit(r["label"]).alias("label"), "cluster")
        every = one if every is None else every.unionByName(one)
    return every


@query("vec_03", f"""with {STATS}, m as (select id, label, round(min(g) filter (where c <> 9), 6) g from ds group by 1, 2), g as (select g, count(*) filter (where label = 9) p, count(*) filter (where label <> 9) n from m group by 1),
  w as (select p, n, p * (coalesce(sum(n) over (order by g rows between unbounded preceding and 1 preceding), 0) + n / 2) won from g) select round(sum(won) / (sum(p) * sum(n)), 8) auroc from w""")
def vec_03(t: Tables) -> DataFrame:
    stats = o.class_stats(vectors(t)).where("label <> 9")
    far = o.class_distance(vectors(t), stats)
    return ag.auroc(far.select(F.col("distance").alias("score"), (F.col("label") == 9).alias("positive")))


MASKED = f"""{LOGITS}, w as (select *, list_transform(ex, lambda x: x / list_sum(ex)) p from b), y as (select id, pred::bigint as label, round(conf, 6) confidence, conf from pred),
  z as (select vec_id id, unnest(range(4)) turn, embedding::double[] v from embeddings where vec_id in (select id from y where conf < 0.9)), k as (select id, turn, list_transform(v, lambda x, i: case when (id + 3 * turn + i - 1) % 4 = 0 then 0.0 else x end) v from z),
  q as (select k.id, turn, c.label, exp(round(-list_sum(list_transform(list_zip(v, p), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 9)) e from k, c), r as (select id, turn, label, e / sum(e) over (partition by id, turn) p from q),
  va as (select id, avg(v) v from (select id, label, var_pop(p) v from r group by 1, 2) group by 1)"""


@query("vec_05", f"with {MASKED} select y.id, y.label, y.confidence, round(-list_sum(list_transform(w.p, lambda x: case when x > 0 then x * ln(x) else 0 end)) / ln(len(w.p)), 6) entropy, round(coalesce(va.v, 0), 8) variance, case when conf < 0.9 then 5 else 1 end::bigint scored from y join w using (id) left join va using (id)")
def vec_05(t: Tables) -> DataFrame:
    """The fixture's model: likelier the nearer a class mean is; every fourth component goes, by id and pass."""
    import numpy as np

    means = np.array([r["p"] for r in class_means(t).orderBy("label").collect()])  # a row per class

    def model(x):
        z = -((x[:, None, :] - means[None]) ** 2).sum(-1).round(9)
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def mask(ids, turn, width):
        return (np.asarray(ids)[:, None] + 3 * turn + np.arange(width)[None, :]) % 4 != 0

    return o.score(vectors(t), model, passes=4, mask=mask)
