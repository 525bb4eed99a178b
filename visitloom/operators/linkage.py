"""Joins that link visits, items, corrections, vectors and rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.functions.scores import dot, l2


def patient_timeline(jobs: DataFrame, items: DataFrame, visits: DataFrame, top: int = 5) -> DataFrame:
    """Jobs with their visit and report, newest clinical time first; a missing report gives zeros; top labels by count."""
    labels = items.groupBy("job_id", "label").agg(F.count("*").alias("k"), F.sum("confidence").alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("m"), F.col("label").alias("label"))))
    report = labels.groupBy("job_id").agg(F.sum("k").alias("n_items"), F.round(F.sum("c") / F.sum("k"), 4).alias("avg_confidence"), F.transform(F.slice(ordered, 1, top), lambda x: x["label"]).alias("top_labels"))
    out = jobs.join(visits, "patient_id", "left").join(report, "job_id", "left")
    return out.select("job_id", "patient_id", "patient", F.col("visit_at").alias("clinical_at"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"), F.coalesce("top_labels", F.array().cast("array<string>")).alias("top_labels"))


def drop_corrected(candidates: DataFrame, corrected: DataFrame) -> DataFrame:
    """Candidates whose text was never corrected anywhere."""
    return candidates.join(corrected.select("text").where("text is not null").distinct(), "text", "left_anti")


def flag_errors(items: DataFrame, corrections: DataFrame) -> DataFrame:
    hit = corrections.select("item_id").distinct().withColumn("hit", F.lit(True))
    return items.join(hit, "item_id", "left").withColumn("is_error", F.col("hit").isNotNull()).drop("hit")


def assign_turn(segments: DataFrame, turns: DataFrame, grain: int = 30) -> DataFrame:
    """The turn that each segment overlaps most; ties to the first, none without overlap.

    segments: recording, seg, start, end. turns: recording, turn, cluster, from_, to_. Both are dealt to slots of grain
    seconds that they touch, so a long recording is many join keys and each segment meets only turns near it.
    """

    def slots(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / grain), F.floor(F.col(b) / grain)))

    s = segments.withColumn("slot", slots("start", "end"))
    t = turns.withColumn("slot", slots("from_", "to_"))
    both = s.join(t, ["recording", "slot"]).withColumn("overlap", F.least("end", "to_") - F.greatest("start", "from_")).where("overlap > 0")
    best = both.groupBy("recording", "seg").agg(F.max_by(F.struct("cluster", "overlap"), F.struct("overlap", (-F.col("turn")).alias("first"))).alias("b"))
    return segments.join(best, ["recording", "seg"], "left").select("recording", "seg", F.col("b.cluster").alias("cluster"), F.round("b.overlap", 4).alias("overlap"))


def cluster_texts(segments: DataFrame) -> DataFrame:
    """The text of each cluster of a recording, segments in order."""
    rows = F.array_sort(F.collect_list(F.struct("seg", "text")))
    return segments.groupBy("recording", "cluster").agg(F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("text"))


def family_conflicts(facts: DataFrame) -> DataFrame:
    """Visit and family in which an allergy meets a medication: sums of each, and pairs, without making the pairs."""
    per = facts.groupBy("visit_id", "family").agg(F.count_if(F.col("kind") == "allergy").alias("allergies"), F.count_if(F.col("kind") == "medication").alias("medications"))
    return per.where("allergies > 0 and medications > 0").withColumn("pairs", F.col("allergies") * F.col("medications"))


def missing_tests(conditions: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """Per visit and condition: tests that an edge requires and that aren't done."""
    wanted = conditions.join(edges.where("relation = 'requires'").select(F.col("source").alias("condition"), F.col("target").alias("test")), "condition")
    return wanted.join(done, ["visit_id", "test"], "left_anti").groupBy("visit_id", "condition").agg(F.array_sort(F.collect_set("test")).alias("missing"))


def edge_sources(edges: DataFrame, relation: str, target: str) -> DataFrame:
    return edges.where((F.col("relation") == relation) & (F.col("target") == target)).select("source")


def valid_tests(done: DataFrame, edges: DataFrame, at: Column) -> DataFrame:
    """Tests that count at a moment: those done and those they satisfy, if not older than the edge's validity."""
    own = done.select("visit_id", "test", "done_at", F.col("test").alias("by"))
    wider = done.join(edges.where("relation = 'satisfies'").select(F.col("source").alias("test"), "target"), "test").select("visit_id", F.col("target").alias("test"), "done_at", F.col("test").alias("by"))
    days = edges.where("relation = 'valid_for'").select(F.col("source").alias("by"), "validity_days")
    every = own.unionByName(wider).join(days, "by", "left")
    return every.where(F.col("validity_days").isNull() | (F.date_diff(at, F.col("done_at")) <= F.col("validity_days"))).select("visit_id", "test").distinct()


def apply_decisions(rows: DataFrame, merges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Labels after merges (old, new) and per-text decisions (text, decision), which win; one row per text and label."""
    out = rows.join(merges.withColumnRenamed("old", "label"), "label", "left").join(decisions, "text", "left")
    final = out.withColumn("final", F.coalesce("decision", "new", "label"))
    first = F.row_number().over(Window.partitionBy("text", "final").orderBy("id"))
    return final.withColumn("nth", first).where("nth = 1").select("id", "text", F.col("final").alias("label"))


#: Blocks a side of what meets in a task.
SIDE = 8
#: Vectors whose cosines with a side are held at a time; likely neighbours of one from which on all are worked out.
ROWS, LIKELY = 64, 16


def _likest(a: np.ndarray, left: np.ndarray, b: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For vectors left of ids a: ids, the vector of right with another id of b (in order) of the highest cosine, and that.

    Cosines in single precision tell which can be the highest: those within twice their error of it, and what rounding to
    9 places makes equal. These are worked out in double precision.
    """
    rough, out, most = np.ascontiguousarray(right.T, np.float32), [], (right.shape[1] + 8) * 2.0**-23 + 2e-9
    for i in range(0, len(a), ROWS):
        own, mine = a[i : i + ROWS], left[i : i + ROWS]
        same = list(zip(np.searchsorted(b, own).tolist(), np.searchsorted(b, own, "right").tolist(), strict=True))
        scores = mine.astype(np.float32) @ rough
        for row, (x, y) in zip(scores, same, strict=True):
            row[x:y] = -9
        high = scores.max(1)
        near = scores >= np.where(high > -9, high - np.float32(most), np.float32(9))[:, None]
        r, c = np.divmod(np.flatnonzero(near), len(b))
        if len(r) <= LIKELY * len(own):
            cosines = np.round(np.einsum("ij,ij->i", mine[r], right[c]), 9)
            order = np.lexsort((c, -cosines, r))  # ids stand in order, so of equal cosines the smallest
            first = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
            out.append((own[r[first]], b[c[first]], cosines[first]))
            continue
        scores = mine @ right.T
        np.round(scores, 9, out=scores)
        for row, (x, y) in zip(scores, same, strict=True):
            row[x:y] = -9
        k = scores.argmax(1)
        best = scores[np.arange(len(k)), k]
        some = best > -9
        out.append((own[some], b[k][some], best[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best(key: tuple, rows: pa.Table) -> pa.Table:
    """Of blocks on the two sides of a meeting: the best vector of the other side for each."""
    sides = {}
    for side, listed in zip(rows["side"].to_pylist(), rows["rows"].combine_chunks(), strict=True):
        held = listed.values
        sides.setdefault(side, []).append((held.field("id").to_numpy(zero_copy_only=False), held.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)))
    order, whole = {}, []
    for side, parts in sides.items():
        ids, v = np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])
        order[side] = (ids[np.argsort(ids)], v[np.argsort(ids)])
    one, other = (x.as_py() for x in key[-2:])
    for x, y in {(one, other), (other, one)}:
        if x in order and y in order:
            whole.append(pa.table(dict(zip(("id", "neighbour", "cosine"), _likest(*order[x], *order[y]), strict=True))))
    return pa.concat_tables([pa.schema([("id", pa.int64()), ("neighbour", pa.int64()), ("cosine", pa.float64())]).empty_table(), *whole])


def nearest(vectors: DataFrame, block: int = 2048, exact: int | None = None) -> DataFrame:
    """The nearest other vector by cosine, ties to the smaller id: id, neighbour, cosine.

    vectors: id, v; rows with a null id or v take no part. All vectors meet, however many they are; exact, up to which they
    once did, changes nothing. They are dealt to parts of about block vectors, and groups of SIDE parts meet in pairs, so
    a vector is sent once for each such group, and what a task holds doesn't grow. The work grows with the square.
    """
    unit = vectors.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), l2(F.col("v")).alias("v"))
    parts = max(1, -(-unit.count() // block))
    last = (parts - 1) // SIDE
    dealt = unit.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("part").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    met = dealt.withColumn("side", F.floor(F.col("part") / SIDE)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    placed = met.select(F.least("side", "other").alias("g"), F.greatest("side", "other").alias("h"), "side", "rows")
    found = placed.groupBy("g", "h").applyInArrow(_best, "id long, neighbour long, cosine double")
    best = F.max_by(F.struct("neighbour", "cosine"), F.struct("cosine", (-F.col("neighbour")).alias("first")))
    return found.groupBy("id").agg(best.alias("b")).select("id", "b.neighbour", "b.cosine")


def neighbours(seed: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """The n candidates nearest to one seed vector."""
    one = seed.select(F.col("id").alias("seed_id"), l2(F.col("v")).alias("s")).limit(1)
    scored = candidates.crossJoin(F.broadcast(one)).where(F.col("id") != F.col("seed_id")).select("seed_id", "id", F.round(dot("s", l2(F.col("v"))), 6).alias("cosine"))
    return scored.orderBy(F.col("cosine").desc(), "id").limit(n)


def best_prototype(vectors: DataFrame, prototypes: DataFrame) -> DataFrame:
    """The likest of a few prototypes (label, p) for each vector. Prototypes are one array, a row per class."""
    listed = prototypes.agg(F.array_sort(F.collect_list(F.struct("label", l2(F.col("p")).alias("p")))).alias("protos"))
    scored = vectors.crossJoin(F.broadcast(listed)).withColumn("u", l2(F.col("v")))
    each = F.transform("protos", lambda p: F.struct(F.round(dot(F.col("u"), p["p"]), 6).alias("similarity"), (-p["label"]).alias("first")))
    return scored.select("id", F.array_max(each).alias("b")).select("id", (-F.col("b.first")).alias("label"), "b.similarity")


def supplement_facts(links: DataFrame, found: DataFrame, parents: DataFrame) -> DataFrame:
    """Structured facts, and those found in text that no structured one of the visit settles: same code, or a parent."""
    key = ["visit_id", "code"]
    wider = links.join(parents.select(F.col("parent").alias("code"), "child"), "code").select("visit_id", F.col("child").alias("code"))
    settled = links.select(*key).union(wider).distinct()
    extra = found.join(settled, key, "left_anti").withColumn("origin", F.lit("text"))
    return links.withColumn("origin", F.lit("link")).unionByName(extra)


def check_rules(fired: DataFrame, must: DataFrame, must_not: DataFrame, prefixes: DataFrame, needed: DataFrame) -> DataFrame:
    """Problems: expected rules that didn't fire, forbidden ones that did, rules under a forbidden prefix, and prefixes
    that a visit needs (visit_id, prefix) and no rule of it has; these stand as the rule.

    Every beginning of a rule's name is joined with the prefixes on equality, however many there are.
    """
    key = ["visit_id", "rule_id"]
    missing = must.join(fired, key, "left_anti").select(*key, F.lit("missing").alias("problem"))
    forbidden = must_not.join(fired, key, "left_semi").select(*key, F.lit("forbidden").alias("problem"))
    begins = F.explode(F.transform(F.sequence(F.lit(1), F.length("rule_id")), lambda n: F.left("rule_id", n)))
    named = fired.select("rule_id").where("rule_id <> ''").distinct().select("rule_id", begins.alias("prefix"))
    bad = named.join(prefixes.select("prefix").distinct(), "prefix").select("rule_id").distinct()
    leaked = fired.join(bad, "rule_id", "left_semi").select(*key, F.lit("leaked").alias("problem")).distinct()
    has = fired.join(named.join(needed.select("prefix").distinct(), "prefix"), "rule_id").select("visit_id", "prefix")
    absent = needed.join(has, ["visit_id", "prefix"], "left_anti").select("visit_id", F.col("prefix").alias("rule_id"), F.lit("absent").alias("problem"))
    return missing.unionByName(forbidden).unionByName(leaked).unionByName(absent)


def compare_runs(base: DataFrame, candidate: DataFrame, gate: float) -> DataFrame:
    """Gain in points of a candidate's score on each set, and whether it passes the gate."""
    both = base.select("name", F.col("score").alias("before")).join(candidate.select("name", F.col("score").alias("after")), "name")
    gain = F.round((F.col("after") - F.col("before")) * 100, 4)
    return both.select("name", "before", "after", gain.alias("gain"), (gain >= gate).alias("passes"))


def backfill(reports: DataFrame, jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Reports of jobs that aren't there yet, with the file named after the job, or without one."""
    stems = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("job"), "path")
    new = reports.join(jobs.select("job_id"), "job_id", "left_anti").withColumn("job", F.col("job_id").cast("string"))
    return new.join(stems, "job", "left").select("job_id", "path", F.when(F.col("path").isNull(), "no_file").otherwise("imported").alias("outcome"))
