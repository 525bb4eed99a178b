"""A prefix trie of conversations, found by digests of fixed-length blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import columns, cut, stored

#: Turns of a block; turns of a conversation that one group of a window holds; ids of a chunk of members.
BLOCK, RUN, CHUNK_IDS = 4, 1 << 12, 1 << 10
#: A conversation takes its first turns from the one at the multiple of HUNDRED below it, fewer than HEADS of them.
HUNDRED, HEADS = 100, 6
#: Digest of a node at which no conversation ends.
NONE = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "kx", "ky"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, a, b, chars): turns with 128 bits of role and text, and the text's code points; null ones are empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.char_length(text).cast("long").alias("chars"))


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each conversation of a sorted partition."""
    part, last, carried = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        inside = np.arange(len(conv)) - np.repeat(begins, np.diff(np.append(begins, len(conv))))
        if conv[0] == last:
            inside[: begins[1] if len(begins) > 1 else len(conv)] += carried
        last, carried = conv[-1], int(inside[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[1:4], pa.array(np.full(len(conv), part, np.int32)), pa.array(inside)], ["conv", "a", "b", "chars", "part", "inside"])


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv, pos, a, b, chars): turns numbered from 0 by turn, null first, then role, then text.

    Ranges of (conv, turn) are sorted and numbered each, so a long conversation is dealt to many tasks; what stands in
    ranges before is added, for which there is at most one row a range. Role and text are sorted by only where different
    turns share a number.
    """
    slim = stored(turns(conversations))
    tied = cut(slim.groupBy("conv", "turn").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1")).where("a0 <> a1 or b0 <> b1").select("conv", "turn"))
    by = ["conv", F.col("turn").asc_nulls_first(), "r", "t", "a", "b"]
    if tied.isEmpty():
        rows = slim.withColumns({"r": F.lit(""), "t": F.lit("")})
    else:
        keyed = tied.select(F.col("conv").alias("c"), F.col("turn").alias("u"))
        whole = turns(conversations).withColumns({"r": F.lit(""), "t": F.lit("")})
        full = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        same = (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("u"))
        alike = full.join(keyed, same, "left_semi")
        alike = alike.select("conv", "turn", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"), F.char_length("text").cast("long").alias("chars"), F.col("role").alias("r"), F.col("text").alias("t"))
        rows = stored(slim.join(keyed, same, "left_anti").select(*slim.columns, F.lit("").alias("r"), F.lit("").alias("t")).unionByName(alike.select(*whole.columns)))
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("conv", "a", "b", "chars")
    inside = stored(sorted_rows.mapInArrow(_numbered, "conv long, a long, b long, chars long, part int, inside long"))
    each = inside.groupBy("conv", "part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = cut(each.withColumn("ahead", ahead).where("ahead is not null").drop("n"))
    return inside.join(before, ["conv", "part"], "left").select("conv", (F.col("inside") + F.coalesce("ahead", F.lit(0))).alias("pos"), "a", "b", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv) and their turns (conv, pos, a, b, chars) after each took its first turns from its hundred's first.

    h is the CRC-32 of the id modulo HEADS; the first h turns come from conversation id - id % HUNDRED, all if it has
    fewer and none if it isn't there; then come its own turns but its first h.
    """
    own = stored(ordered(conversations))
    h = (F.crc32(F.col("conv").cast("string")) % HEADS).cast("long")
    heads = cut(own.where(F.col("pos") < HEADS - 1).withColumnRenamed("conv", "base"))
    have = heads.groupBy("base").agg(F.count("*").alias("have"))
    convs = cut(own.select("conv").distinct().withColumns({"h": h, "base": F.col("conv") - F.col("conv") % HUNDRED}).join(have, "base", "left").withColumn("lack", F.greatest(F.col("h") - F.coalesce("have", F.lit(0)), F.lit(0))))
    first = convs.select("conv", "base", "h").join(heads, "base").where("pos < h").select("conv", "pos", "a", "b", "chars")
    short = convs.where("lack > 0").select("conv", "lack")
    rest = own.where(F.col("pos") >= h).join(short, "conv", "left").select("conv", (F.col("pos") - F.coalesce("lack", F.lit(0))).alias("pos"), "a", "b", "chars")
    return convs.select("conv"), first.unionByName(rest)


def _xor(*parts: Column) -> Column:
    return reduce(lambda x, y: x.bitwiseXOR(y), parts)


def blocks(rows: DataFrame) -> DataFrame:
    """A row per conversation and block of BLOCK turns: conv, nth, size, what its turns hash to, and px, py of all before.

    A turn hashes to 128 bits of its place, role and text; a run of turns to the exclusive or of its turns, so that what
    stands before a block is added up over runs of blocks and no conversation must meet in one task.
    """
    seeded = rows.select("conv", "pos", "chars", F.floor(F.col("pos") / BLOCK).alias("nth"), F.floor(F.col("pos") / RUN).alias("run"), F.xxhash64(F.lit(1), "pos", "a", "b").alias("x"), F.xxhash64(F.lit(2), "pos", "a", "b").alias("y"))
    at = [F.col("pos") % BLOCK == j for j in range(BLOCK)]
    of_turns = [F.max(F.when(at[j], F.col(c))).alias(f"{c}{j}") for j in range(BLOCK) for c in ("x", "y", "chars")]
    each = seeded.repartition("conv", "run").groupBy("conv", "run", "nth").agg(F.count("*").alias("size"), F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), *of_turns)
    before = Window.partitionBy("conv", "run").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    each = stored(each.withColumns({"ix": F.coalesce(F.bit_xor("bx").over(before), F.lit(0)), "iy": F.coalesce(F.bit_xor("by").over(before), F.lit(0))}))
    runs = each.groupBy("conv", "run").agg(F.bit_xor("bx").alias("rx"), F.bit_xor("by").alias("ry"))
    ahead = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "run", F.bit_xor("rx").over(ahead).alias("rx"), F.bit_xor("ry").over(ahead).alias("ry")).where("run > 0")
    px, py = (_xor(F.col(f"i{c}"), F.coalesce(f"r{c}", F.lit(0))) for c in "xy")
    return each.join(cut(runs), ["conv", "run"], "left").withColumns({"px": px, "py": py}).drop("run", "ix", "iy", "rx", "ry")


def nodes(each: DataFrame, smallest: int, n: int) -> DataFrame:
    """(conv, depth, n_convs, chars, kx, ky, px, py): nodes with their smallest member, their key and their parent's.

    Equal blocks after equal beginnings become one row with a count first. Where only one block follows a beginning, its
    turns have that block's members; where several do, their turns are counted by key again.
    """
    end = [(F.col("nth") * BLOCK + F.col("size")).alias("depth"), _xor(F.col("px"), F.col("bx")).alias("kx"), _xor(F.col("py"), F.col("by")).alias("ky")]
    carried = ["nth", "size", "px", "py", *(f"{c}{j}" for j in range(BLOCK) for c in ("x", "y", "chars"))]
    kinds = stored(each.select("conv", *end, *carried).groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv").alias("conv"), *[F.max(c).alias(c) for c in carried]))
    forks = kinds.where("nth > 0").groupBy("nth", "px", "py").agg(F.count("*").alias("ways")).where("ways > 1").drop("ways").withColumn("forked", F.lit(True))
    at_root = kinds.where("nth = 0").count() > 1
    later = kinds.where("nth > 0").join(forks, ["nth", "px", "py"], "left").withColumn("forked", F.coalesce("forked", F.lit(False)))
    marked = later.unionByName(kinds.where("nth = 0").withColumn("forked", F.lit(at_root)))
    path, step = (F.col("px"), F.col("py")), []
    for j in range(BLOCK):
        here = (_xor(path[0], F.col(f"x{j}")), _xor(path[1], F.col(f"y{j}")))
        step.append(F.struct((F.col("nth") * BLOCK + j + 1).alias("depth"), F.col(f"chars{j}").alias("chars"), here[0].alias("kx"), here[1].alias("ky"), path[0].alias("px"), path[1].alias("py")))
        path = here
    opened = marked.select("forked", "conv", F.col("n").alias("n_convs"), F.explode(F.slice(F.array(*step), F.lit(1), F.col("size").cast("int"))).alias("s")).select("forked", "conv", "n_convs", "s.*")
    names = ["conv", "depth", "n_convs", "chars", "kx", "ky", "px", "py"]
    straight = opened.where("not forked").select(*names)
    met = opened.where("forked").groupBy(*KEY).agg(F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"), *[F.max(c).alias(c) for c in ("chars", "px", "py")])
    root = each.sparkSession.range(1).select(F.lit(smallest).cast("long").alias("conv"), F.lit(0).cast("long").alias("depth"), F.lit(n).cast("long").alias("n_convs"), *[F.lit(0).cast("long").alias(c) for c in names[3:]])
    return straight.unionByName(met.select(*names)).unionByName(root)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, kx, ky, conv) to runs of a node's ids, joined by commas."""
    key, ids, out = None, [], []

    def flush() -> None:
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch_of() -> pa.RecordBatch:
        made = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, [pa.int64()] * 4 + [pa.string()], strict=True)], [*KEY, "first", "ids"])

    for batch in batches:
        for *k, conv in zip(*columns(batch, *KEY, "conv"), strict=True):
            if k != key or len(ids) == CHUNK_IDS:
                flush()
                key = k
            ids.append(conv)
        yield batch_of()
    flush()
    yield batch_of()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to the digest of each node's ids, which are never held together."""
    key, state, out = None, None, []
    for batch in batches:
        for *k, ids in zip(*columns(batch, *KEY, "ids"), strict=True):
            if k != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        made = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, [pa.int64()] * 3 + [pa.string()], strict=True)], [*KEY, "ends"])
        out.clear()
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, state.hexdigest()), [pa.int64()] * 3 + [pa.string()], strict=True)], [*KEY, "ends"])


def ends(convs: DataFrame, each: DataFrame) -> DataFrame:
    """(depth, kx, ky, ends): for nodes at which conversations end, the SHA-256 of their ids in order, comma-joined."""
    none = convs.select("conv", *[F.lit(0).cast("long").alias(c) for c in ("size", "bx", "by")])
    at = stored(each.select("conv", "size", "bx", "by").unionByName(none).groupBy("conv").agg(F.sum("size").alias("depth"), F.bit_xor("bx").alias("kx"), F.bit_xor("by").alias("ky")))
    ids = at.select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    chunks = ids.mapInArrow(_chunks, "depth long, kx long, ky long, first long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed, "depth long, kx long, ky long, ends string")


def lines(found: DataFrame, smallest: int) -> DataFrame:
    """(conv, top, bottom, saved, up, at, leaf): the nodes that have the same smallest member stand in line, from depth top
    to bottom; saved is their sum; up is the smallest member of the node above, at its depth (null at the root's line);
    leaf is 1 where nothing hangs at the bottom, else 0."""
    top = F.min(F.struct("depth", "px", "py"))
    line = stored(found.groupBy("conv").agg(top.alias("t"), F.max("depth").alias("bottom"), F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved")).select("conv", F.col("t.depth").alias("top"), "bottom", "saved", F.col("t.px").alias("px"), F.col("t.py").alias("py")))
    below = line.where("top > 1").select("conv", "top", "bottom", "saved", (F.col("top") - 1).alias("depth"), F.col("px").alias("kx"), F.col("py").alias("ky")).join(found.select(*KEY, F.col("conv").alias("up")), KEY)
    first = line.where("top <= 1").select("conv", "top", "bottom", "saved", F.when(F.col("top") == 1, F.lit(smallest).cast("long")).alias("up"), F.when(F.col("top") == 1, F.lit(0).cast("long")).alias("at"))
    every = stored(first.unionByName(below.select("conv", "top", "bottom", "saved", "up", F.col("depth").alias("at"))))
    held = every.where("up is not null").select(F.col("up").alias("conv"), F.col("at").alias("bottom")).distinct().withColumn("leaf", F.lit(0))
    return every.join(held, ["conv", "bottom"], "left").na.fill(1, ["leaf"])


def summed(line: DataFrame, smallest: int) -> DataFrame:
    """(conv, leaves, saved): what a line and all lines below it hold.

    Each round adds to a line what its descendants within twice the reach hold, and doubles how far up it points; so the
    rounds grow with the logarithm of how many lines hang below one another.
    """
    now = line.select("conv", F.col("up").alias("over"), F.col("leaf").cast("long").alias("leaves"), "saved")
    while True:
        now = cut(now)
        live = now.where("over is not null")
        if live.isEmpty():
            return now.drop("over")
        more = live.groupBy(F.col("over").alias("conv")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        known = now.where(F.col("over").isNull() | (F.col("over") == smallest)).withColumn("over", F.lit(None).cast("long"))
        deep = now.where(F.col("over") != smallest).join(now.select(F.col("conv").alias("over"), F.col("over").alias("next")), "over").select("conv", F.col("next").alias("over"), "leaves", "saved")
        both = known.unionByName(deep).join(more, "conv", "left")
        now = both.select("conv", "over", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of rebuilt conversations (conv_id, turn, role, text): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns without conv_id take no part; null roles and texts are empty; null turns come first; different turns of the
    same number are ordered by role, then text; repeated rows are turns of their own. Without rows there are no nodes;
    a conversation without turns of its own ends where its first turns do. Other columns are ignored.

    A node is its smallest member and its depth. Nodes with the same smallest member stand in line, so the trie is a tree
    of lines, one a conversation at most; sums below a node are what stands below it in its line, and whole lines that
    hang there. Texts equal in 128 bits count as equal.
    """
    spark = conversations.sparkSession
    convs, rows = rebuilt(conversations)
    whole = convs.agg(F.min("conv"), F.count("*")).first()
    if not whole[1]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    each = stored(blocks(rows))
    found = stored(nodes(each, *whole))
    line = stored(lines(found, whole[0]))
    sums = summed(line, whole[0])
    hang = line.where("up is not null").select("conv", "up", "at").join(sums, "conv").groupBy(F.col("up").alias("conv"), F.col("at").alias("depth")).agg(F.count("*").alias("kids"), F.sum("leaves").alias("kl"), F.sum("saved").alias("ks"))
    held = found.select("conv", "depth", "n_convs", "chars", "kx", "ky").join(hang, ["conv", "depth"], "left").na.fill(0, ["kids", "kl", "ks"])
    held = held.withColumns({"own": F.col("ks") + (F.col("n_convs") - 1) * F.col("chars"), "run": F.floor(F.col("depth") / RUN)})
    down = Window.partitionBy("conv", "run").orderBy(F.col("depth").desc())
    held = stored(held.withColumns({"l": F.sum("kl").over(down), "s": F.sum("own").over(down)}))
    later = Window.partitionBy("conv").orderBy(F.col("run").desc()).rowsBetween(Window.unboundedPreceding, -1)
    runs = held.groupBy("conv", "run").agg(F.sum("kl").alias("rl"), F.sum("own").alias("rs")).select("conv", "run", F.sum("rl").over(later).alias("rl"), F.sum("rs").over(later).alias("rs")).where("rl is not null")
    out = held.join(cut(runs), ["conv", "run"], "left").join(line.select("conv", "top", "bottom", "up", "leaf"), "conv").join(ends(convs, each), KEY, "left")
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("up")).alias("parent_conv_id"),
        "n_convs",
        (F.col("kids") + F.when(F.col("depth") < F.col("bottom"), 1).otherwise(0)).cast("long").alias("n_children"),
        (F.col("l") + F.coalesce("rl", F.lit(0)) + F.col("leaf")).cast("long").alias("n_leaves"),
        (F.col("s") + F.coalesce("rs", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"),
    )


def oracle_sql() -> str:
    """The same in DuckDB's SQL, over the table conversations."""
    step = "case when {0} & 1 = 1 then xor({0} >> 1, 3988292384) else {0} >> 1 end"
    return f"""
    with recursive bytes(b, k, c) as (
      select b, 0, b::bigint from range(256) t(b) union all select b, k + 1, {step.format("c")} from bytes where k < 8),
    crc_table as (select b, c from bytes where k = 8),
    ids as (select distinct conv_id::bigint conv from conversations where conv_id is not null),
    crc(conv, k, c) as (
      select conv, 0, 4294967295::bigint from ids union all
      select conv, k + 1, xor(t.c, crc.c >> 8) from crc join crc_table t on t.b = xor(crc.c, ascii(substr(conv::varchar, k + 1, 1))::bigint) & 255
      where k < length(conv::varchar)),
    heads as (select conv, xor(c, 4294967295::bigint) % {HEADS} h, conv - conv % {HUNDRED} base from crc where k = length(conv::varchar)),
    own as (
      select conv_id::bigint conv, coalesce(role, '') r, coalesce(text, '') t, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 pos
      from conversations where conv_id is not null),
    parts as (
      select h.conv, 0 part, o.pos, o.r, o.t from heads h join own o on o.conv = h.base and o.pos < h.h union all
      select h.conv, 1, o.pos, o.r, o.t from heads h join own o on o.conv = h.conv and o.pos >= h.h),
    seqs as (select conv, list(md5(length(r) || ':' || r || t) order by part, pos) s, list(length(t) order by part, pos) n from parts group by conv),
    every as (select h.conv, coalesce(s, []) s, coalesce(n, []) n from heads h left join seqs using (conv)),
    prefixes as (select conv, d depth, list_slice(s, 1, d) p, case when d = 0 then 0 else n[d] end chars, len(s) = d as here from every, unnest(range(len(s) + 1)) t(d)),
    nodes as (
      select depth, p, min(conv) conv_id, count(*) n_convs, max(chars) chars,
        sha256(coalesce(string_agg(conv::varchar, ',' order by conv) filter (where here), '')) ends_sha256
      from prefixes group by depth, p),
    kids as (select depth - 1 depth, list_slice(p, 1, depth - 1) p, count(*) n_children from nodes where depth > 0 group by 1, 2),
    full_nodes as (select n.*, coalesce(k.n_children, 0) n_children from nodes n left join kids k using (depth, p)),
    below as (
      select a.depth, a.p, count(*) filter (where b.n_children = 0) n_leaves, sum((b.n_convs - 1) * b.chars) saved_tokens
      from full_nodes a join full_nodes b on b.depth >= a.depth and list_slice(b.p, 1, a.depth) = a.p group by 1, 2)
    select n.conv_id, n.depth::bigint as depth, up.conv_id parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens::bigint saved_tokens, n.ends_sha256
    from full_nodes n join below b using (depth, p) left join nodes up on up.depth = n.depth - 1 and up.p = list_slice(n.p, 1, n.depth - 1)"""
