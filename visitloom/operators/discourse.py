"""Ordered rows of a transcript or a label: splits, packs, scopes, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.operators.ranks import running


def dedupe_first(rows: DataFrame, text: str, position: str) -> DataFrame:
    """The first row of each text, and how many others went (removed). Copies meet map-side, not in a window."""
    whole = F.struct(*[c for c in rows.columns if c != text])
    per = rows.groupBy(text).agg(F.min_by(whole, position).alias("first"), (F.count("*") - 1).alias("removed"))
    return per.select("first.*", text, "removed").select(*rows.columns, "removed")


def quota(rows: DataFrame, label: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("nth") <= n).drop("nth")


def stratified_split(rows: DataFrame, label: str, key: str, seed: str) -> DataFrame:
    """test, val or train for each row: 15 % each of a label by a hash order, rounded half to even; a label of three or
    more has at least one in either.

    All rows are ranked at once, range by range, label after label; a label's first rank is what the labels before hold,
    and labels are few. Rows without a label are a label of their own, the first.
    """
    hashed = rows.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col(label).cast("string"), F.col(key).cast("string")))).withColumn("_one", F.lit(1))
    ranked = running(hashed, [F.col(label).asc_nulls_first(), "_order", key], ["_one"])
    sizes = ranked.groupBy(F.col(label).alias("_of")).agg(F.count("*").alias("n"), F.min("before__one").alias("first"))
    both = ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_of"))).withColumn("nth", F.col("before__one") - F.col("first") + 1)
    n = F.col("n")
    share = F.bround(n * 0.15)
    least = F.when(n >= 3, F.greatest(share, F.lit(1.0))).otherwise(share)
    test = F.least(least, n - 1)
    val = F.least(least, n - test - 1)
    part = F.when(F.col("nth") <= test, "test").when(F.col("nth") <= test + val, "val").otherwise("train")
    return both.select(*rows.columns, part.alias("part"))


def continuation_flags(rows: DataFrame, key: str, start: str, end: str, order: str, low: float = -0.25, high: float = 1.5) -> DataFrame:
    """Whether a row begins within low to high seconds of the end of the one before."""
    gap = F.col(start) - F.lag(end).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("continues", F.coalesce(gap.between(low, high), F.lit(False)))


def context_window(rows: DataFrame, flag: Column, back: int, ahead: int = 0) -> Column:
    """Whether the flag holds in any row from back rows before to ahead rows after this one (negative: before)."""
    return F.coalesce(F.max(flag).over(Window.partitionBy("job_id").orderBy("order_index").rowsBetween(-back, ahead)), F.lit(False))


def ever_since(flag: Column) -> Column:
    return F.max(flag).over(Window.partitionBy("job_id").orderBy("order_index").rowsBetween(Window.unboundedPreceding, 0))


def conditional_scope(rows: DataFrame) -> DataFrame:
    """Tags of rows in a conditional: condition, action or none, by job in order.

    rows: job_id, order_index, opens, closes, joins, danger (booleans). A row that opens starts a scope and is condition;
    in a scope one that closes is action and ends it, one that joins or lists dangers is condition, any other ends it.
    The state is folded over a job's rows, so a job must fit in memory: jobs are visits, some hundred rows.
    """
    listed = F.array_sort(F.collect_list(F.struct("order_index", "opens", "closes", "joins", "danger")))
    empty = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<order_index:bigint,tag:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        tag = F.when(x["opens"], "condition").when(~state["open"], "none").when(x["closes"], "action").when(x["joins"] | x["danger"], "condition").otherwise("none")
        row = F.struct(x["order_index"].cast("bigint").alias("order_index"), tag.alias("tag"))
        return F.struct((tag == "condition").alias("open"), F.concat(state["out"], F.array(row)).alias("out"))

    done = rows.groupBy("job_id").agg(F.aggregate(listed, empty, step, lambda s: s["out"]).alias("out"))
    return done.select("job_id", F.inline("out"))


def merge_short(rows: DataFrame, least: int = 20, most: int = 140) -> DataFrame:
    """Neighbours of one speaker joined where either is shorter than least and both make most at most; then renumbered.

    rows: job_id, order_index, speaker, text, confidence, is_suspect. The weakest confidence and any suspicion stay.
    """
    listed = F.array_sort(F.collect_list(F.struct("order_index", "speaker", "text", "confidence", "is_suspect")))
    kind = "array<struct<speaker:string,text:string,confidence:double,is_suspect:boolean>>"

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        fits = (F.size(out) > 0) & (last["speaker"] == x["speaker"]) & ((F.length(last["text"]) < least) | (F.length(x["text"]) < least)) & (F.length(last["text"]) + 1 + F.length(x["text"]) <= most)
        own = F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"), x["confidence"].cast("double").alias("confidence"), x["is_suspect"].alias("is_suspect"))
        both = F.struct(x["speaker"].alias("speaker"), F.concat_ws(" ", last["text"], x["text"]).alias("text"), F.least(last["confidence"], x["confidence"]).cast("double").alias("confidence"), (last["is_suspect"] | x["is_suspect"]).alias("is_suspect"))
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(own)))

    done = rows.groupBy("job_id").agg(F.aggregate(listed, F.array().cast(kind), step).alias("out"))
    return done.select("job_id", F.posexplode("out").alias("order_index", "r")).select("job_id", "order_index", "r.*")


def split_by_words(rows: DataFrame, pause: float = 0.5, most: int = 140) -> DataFrame:
    """Segments cut at a pause or before most characters overflow. rows: id, words array<struct<word, start, end>>."""
    kind = "array<struct<text:string,start:double,end:double>>"

    def step(out: Column, w: Column) -> Column:
        last = F.element_at(out, -1)
        new = (F.size(out) == 0) | (w["start"] - last["end"] > pause) | (F.length(last["text"]) + 1 + F.length(w["word"]) > most)
        own = F.struct(w["word"].alias("text"), w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end"))
        more = F.struct(F.concat_ws(" ", last["text"], w["word"]).alias("text"), last["start"].alias("start"), w["end"].cast("double").alias("end"))
        return F.when(new, F.concat(out, F.array(own))).otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(more)))

    return rows.select("id", F.posexplode(F.aggregate("words", F.array().cast(kind), step)).alias("part", "r")).select("id", "part", "r.*")


def split_by_count(rows: DataFrame, most: int = 140) -> DataFrame:
    """Texts cut by words into parts of most characters, times by share of characters. rows: id, text, start, end."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")

    def step(out: Column, w: Column) -> Column:
        last = F.element_at(out, -1)
        fits = (F.size(out) > 0) & (F.length(last) + 1 + F.length(w) <= most)
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat_ws(" ", last, w)))).otherwise(F.concat(out, F.array(w)))

    parts = rows.select("id", "start", "end", F.aggregate(words, F.array().cast("array<string>"), step).alias("parts"))
    total = F.aggregate("parts", F.lit(0), lambda a, p: a + F.length(p))
    long = parts.select("id", "start", "end", "parts", total.alias("total"), F.posexplode("parts").alias("part", "text"))
    before = F.aggregate(F.slice("parts", 1, F.col("part")), F.lit(0), lambda a, p: a + F.length(p))
    span = F.col("end") - F.col("start")
    return long.select("id", "part", "text", F.round(F.col("start") + span * before / F.col("total"), 4).alias("start"), F.round(F.col("start") + span * (before + F.length("text")) / F.col("total"), 4).alias("end"))


def build_segments(transcripts: DataFrame, turns: DataFrame, most: int = 140) -> DataFrame:
    """Segments of transcripts: empty ones dropped, long ones split, each with the speaker of the turn it overlaps most."""
    from visitloom.operators.linkage import assign_turn

    clean = transcripts.withColumn("text", F.trim("text")).where("text <> ''")
    parts = split_by_count(clean.select(F.struct("recording", "seg").alias("id"), "text", "start", "end"), most)
    order = F.row_number().over(Window.partitionBy("id.recording").orderBy("id.seg", "part")) - 1
    numbered = parts.withColumn("n", order).select(F.col("id.recording").alias("recording"), F.col("n").alias("seg"), "text", "start", "end")
    return numbered.join(assign_turn(numbered, turns), ["recording", "seg"]).select("recording", "seg", "text", "start", "end", "cluster")


def representatives(vectors: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    """The n vectors of each cluster nearest to its centre. vectors: id, label, v. centres: label, p."""
    gap = F.aggregate(F.zip_with("v", "p", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    near = vectors.join(F.broadcast(centres), "label").select("id", "label", F.round(F.sqrt(gap), 6).alias("distance"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("distance", "id"))).where(F.col("rank") <= n)


def pack_blocks(texts: DataFrame, size: int, ranges: int = 64) -> DataFrame:
    """Fixed blocks of size words over all texts in order of id; the tail is dropped.

    Running sums go over ranges of ids first, then within a range, so no task sorts the whole stream. Returns block, at,
    id, n: the words of a text in a block.
    """
    sized = texts.select("id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long").alias("n")).where("n > 0")
    bounds = sized.stat.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.001)
    edges = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    dealt = sized.withColumn("part", F.size(F.filter(edges, lambda b: b <= F.col("id"))))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("k"))
    ahead = sums.select("part", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("k").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("inside", inside).join(F.broadcast(ahead), "part").withColumn("begin", F.col("inside") + F.col("ahead"))
    long = placed.withColumn("block", F.explode(F.expr(f"sequence(begin div {size}, (begin + n - 1) div {size})"))).where(F.col("block") < F.expr(f"total div {size}"))
    words = F.least(F.col("begin") + F.col("n"), (F.col("block") + 1) * size) - F.greatest("begin", F.col("block") * size)
    return long.select("block", "id", F.greatest(F.col("begin") - F.col("block") * size, F.lit(0)).alias("at"), words.alias("n"))
