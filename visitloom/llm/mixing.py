"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import cut, stored

#: Weights of the sources in order of their names, over and over.
WEIGHTS = (5, 2, 1)
#: What the mix takes in all, as a share of all words, and at most of any source.
TOTAL, MOST = 1.5, 2.0
#: The fraction of the golden ratio: multiples of it, modulo 1, fill the unit interval evenly at every length.
GOLDEN = 0.6180339887498949
#: About so many slots, but a slot stands for at most BLOCK words; so the number of slots grows with the input beyond.
SLOTS, BLOCK = 1 << 20, 1024
#: The schedule is ranked in runs of so many slots; a source's documents are shuffled in ranges of about so many rows, of
#: which there are some at least; points are looked up in so many cells of the unit interval.
RUN, ROWS, RANGES, CELLS = 1 << 13, 1 << 16, 64, 1 << 10


def size_of(text: Column) -> Column:
    """Words between white space; null: 0."""
    gaps = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(gaps == "", 0).otherwise(F.length(gaps) - F.length(F.replace(gaps, F.lit(" "))) + 1).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from rows with source and size.

    Sources stand in order of code points, null last, and weigh WEIGHTS in turn. They share TOTAL of all words by
    weight; where that is above MOST times a source's words the excess goes to the others by weight, until none is
    above. Sources reach their limits in the order of limit over weight, so running sums over sources find who is at it.
    """
    each = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    limit = F.col("source_size") * MOST
    weighed = each.withColumn("weight", weight).withColumn("level", limit / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    shared = weighed.withColumn("left", F.sum("source_size").over(whole) * TOTAL - F.coalesce(F.sum(limit).over(before), F.lit(0.0))).withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    full = F.col("level") <= F.col("left") / F.col("rest")
    level = F.max(F.when(~full, F.col("left") / F.col("rest"))).over(whole)
    target = F.when(full, limit).otherwise(level * F.col("weight"))
    return shared.select("source", "source_size", "weight", target.alias("target"))


def n_slots(shares: DataFrame) -> int:
    """How many slots the mix has: one a word up to SLOTS, one for each BLOCK words beyond."""
    whole = shares.agg(F.sum("target")).first()[0] or 0.0
    return math.ceil(whole / max(1, min(BLOCK, math.ceil(whole / SLOTS))))


def schedule(shares: DataFrame) -> DataFrame:
    """(slot, source, rank, slots): which source each slot of the mix takes from; rank counts a source's slots from 0,
    slots is how many it has.

    Slot i stands at the fraction of i * GOLDEN; cumulative targets cut the unit interval into the sources' parts. A
    source whose part no point falls on gets a slot of its own behind the others.
    """
    spark, n = shares.sparkSession, n_slots(shares)
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("target").over(Window.partitionBy())
    last = F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())) == 1
    parts = shares.where("target > 0").select("source", F.when(last, 1.0).otherwise(F.sum("target").over(order) / whole).alias("upto"), F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("nth"))
    parts = cut(parts.withColumn("from", F.coalesce(F.lag("upto").over(Window.orderBy("nth")), F.lit(0.0))))
    # Parts stand in each cell that they reach into, so a point meets the parts of its cell only.
    spread = parts.select("source", "from", "upto", F.explode(F.sequence(F.floor(F.col("from") * CELLS), F.least(F.floor(F.col("upto") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    turn = F.col("id") * F.lit(GOLDEN)
    points = spark.range(0, n, 1, max(1, min(math.ceil(n / RUN), 1 << 16))).select(F.col("id").alias("slot"), (turn - F.floor(turn)).alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    hit = points.join(spread, "cell").where("point >= `from` and point < upto").select("slot", "source", F.floor(F.col("slot") / RUN).alias("run"))
    found = stored(hit)
    per_run = found.groupBy("source", "run").agg(F.count("*").alias("n"))
    of_source = Window.partitionBy("source")
    ahead = per_run.select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(of_source.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("n").over(of_source).alias("slots"))
    inside = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    ranked = found.withColumn("inside", inside).join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    none = parts.join(found.select(F.col("source").alias("s")).distinct(), F.col("source").eqNullSafe(F.col("s")), "left_anti")
    late = none.select((F.lit(n) + F.col("nth")).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("slots"))
    return ranked.select("slot", "source", (F.col("inside") + F.col("ahead")).cast("long").alias("rank"), "slots").unionByName(late)


def begin(rank: Column) -> Column:
    """The first word of a source's block; its slots share its words evenly, to the word."""
    return F.when(rank >= F.col("slots"), F.col("words")).otherwise(F.floor(rank * (F.col("words") / F.col("slots")))).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source, source_size, target, taken, row_hash,
    first_slot, last_slot.

    Each source's documents stand on end in the order of a hash of their id and text, twice. The slots of `schedule` that
    fall to a source take its target, to the word, from the beginning, in blocks of equal length, in order. taken: the
    words of a document in the blocks taken, repeats counted, so at most twice its size; a source's sum is its target,
    rounded. row_hash: the hash of id and text. first_slot, last_slot: where in the mix a document stands, the
    first and the last slot of the schedule whose block has words of it (null if none has); read in order of slots, each
    beginning of the mix holds the sources in proportion to their targets, to within a few slots.

    Null or empty texts have size 0 and are taken 0 times. A null source is a source, the last. Repeated rows stand next
    to each other and count one by one; where all is equal it doesn't matter which comes first. Without any words every
    target is 0. Other columns are ignored.
    """
    sized = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("row_hash")))
    shares = cut(targets(sized))
    ranges = max(RANGES, math.ceil(sized.count() / ROWS))
    hashed = sized.withColumn("range", F.pmod("row_hash", F.lit(ranges)))
    per_range = hashed.groupBy("source", "range").agg(F.sum("size").alias("n"))
    ahead = per_range.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    nth = Window.partitionBy("source", "range").orderBy("row_hash", "doc_id", "size")
    before = nth.rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("nth", F.row_number().over(nth))
    placed = placed.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn("begin", F.col("inside") + F.col("ahead")).drop("s", "r", "inside", "ahead")
    slots = stored(schedule(shares))
    have = slots.where("rank = 0").select(F.col("source").alias("s"), "slots")
    of = cut(shares.join(have, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", F.round("target").cast("long").alias("words"), "slots"))
    rows = stored(placed.join(of, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    # A document stands at begin and, in the second round, source_size later; its first and last slot by even division,
    # one more on either side for what rounding does.
    laps = rows.where("size > 0 and words > 0").withColumn("at", F.explode(F.array("begin", F.col("begin") + F.col("source_size")))).where("at < words")
    each = F.col("words") / F.col("slots")
    first, final = F.greatest(F.floor(F.col("at") / each) - 1, F.lit(0)), F.least(F.floor((F.col("at") + F.col("size")) / each) + 1, F.col("slots") - 1)
    pieces = laps.select("source", "range", "nth", "at", "size", "words", "slots", F.explode(F.sequence(first, final)).alias("rank"))
    overlap = F.least(F.col("at") + F.col("size"), begin(F.col("rank") + 1)) - F.greatest(F.col("at"), begin(F.col("rank")))
    pieces = pieces.select("source", "range", "nth", "rank", overlap.alias("got")).where("got > 0")
    p, t = pieces.alias("p"), slots.select("source", "rank", "slot").alias("t")
    met = p.join(t, F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.rank") == F.col("t.rank")))
    got = met.groupBy("p.source", "p.range", "p.nth").agg(F.sum("p.got").alias("taken"), F.min("t.slot").alias("first_slot"), F.max("t.slot").alias("last_slot"))
    r, g = rows.alias("r"), got.alias("g")
    out = r.join(g, F.col("r.source").eqNullSafe(F.col("g.source")) & (F.col("r.range") == F.col("g.range")) & (F.col("r.nth") == F.col("g.nth")), "left")
    return out.select("r.doc_id", "r.size", "r.source", "r.source_size", "r.target", F.coalesce("g.taken", F.lit(0)).cast("long").alias("taken"), "r.row_hash", "g.first_slot", "g.last_slot")
