"""Near duplicates: b-bit MinHash signatures, band candidates, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import CHUNK, columns, cut, slices, stored
from visitloom.llm.components import components

#: Hashes in BANDS bands of ROWS: two sets of similarity 0.8 share no band with a chance of 3 in a million.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Bits kept of each minimum of a signature. Candidates' signatures have more minima, for a closer estimate.
LOW_BITS, CLOSER = 2, 512
#: A candidate is dropped unconfirmed if its estimate is so far below the threshold: five standard deviations.
MARGIN = 0.105
#: Buckets are compared pair by pair once that takes at most so many pairs a row; before, in turns, with one node each,
#: for as long as a turn brings the number of pairs down by a tenth.
FEW, SHRINK = 4, 0.9
#: About so many nodes, and shingles, make a part of a bucket; parts meet pair by pair, so many shingles at a time.
SQUARE, FULL, WIDE = 2048, 1 << 20, 1 << 13
#: A bucket's rows are dealt in parts of about so many when it meets a row of its own.
SPLIT = 512
#: Parts of a set's links that are confirmed in one task, by a hash of the other set.
SALTS = 32
PER_CENT = 80

_random = np.random.default_rng(20240607)
FACTORS = _random.integers(1, 1 << 32, CLOSER, dtype=np.uint32) | np.uint32(1)
TERMS = _random.integers(0, 1 << 32, CLOSER, dtype=np.uint32)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size, base = max(n, CHUNK + 65536), 0x5851F42D4C957F2D
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct runs of width words; of all its words, if they are fewer."""
    flat = [b" ".join((x or "").encode().lower().split()) for x in texts]
    data = np.frombuffer(b" ".join([*flat, b""]), np.uint8)
    up, down = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    out, base = [], 0
    for x in flat:
        n = len(x)
        if not n:
            out.append(np.zeros(0, np.uint64))
            base += 1
            continue
        ends = np.append(np.flatnonzero(data[base : base + n] == 32), n) + base
        begins = np.append(base, ends[:-1] + 1)
        k = min(width, len(ends))
        begin, end = begins[: len(begins) - k + 1], ends[k - 1 :]
        h = (total[end] - total[begin]) * down[begin]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out.append(np.unique(h))
        base += n + 1
    return out


def minima(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """The minima of each set that isn't empty, a row each."""
    full = [s for s in sets if len(s)]
    out = np.empty((len(full), hashes), np.uint32)
    for a, b in slices([len(s) for s in full], 1 << 15):
        every = np.concatenate(full[a:b])
        x = (every >> np.uint64(32)).astype(np.uint32) ^ every.astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in full[a : b - 1])])
        scratch = np.empty_like(x)
        for k in range(hashes):
            np.multiply(x, FACTORS[k], out=scratch)
            scratch += TERMS[k]
            scratch ^= scratch >> np.uint32(15)
            scratch *= np.uint32(0x2C1B3C6D)
            out[a:b, k] = np.minimum.reduceat(scratch, starts)
    return out


def _sketcher(width: int):
    """Of batches with text as the last column: the other columns, the size and key of its set, its band hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for i, j in slices([len(x or "") for x in texts], CHUNK):
                sets = shingle_sets(texts[i:j], width)
                n = [len(s) for s in sets]
                keys = [_key(s) for s in sets]
                m = minima(sets)
                bands = np.zeros((len(m), BANDS), np.uint64)
                for k in range(ROWS):
                    bands = (bands ^ m[:, k::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    bands ^= bands >> np.uint64(29)
                bands = (bands & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)
                lists: list[list | None] = [None] * len(sets)
                for at, b in zip([k for k, x in enumerate(n) if x], bands.view(np.int64).tolist(), strict=True):
                    lists[at] = b
                own = batch.slice(i, j - i)
                kept = [own.column(k) for k in range(own.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), *(pa.array([x and x[k] for x in keys], pa.int64()) for k in (0, 1)), pa.array(lists, pa.list_(pa.int64()))], [*own.schema.names[:-1], "n_shingles", "key", "key2", "bands"])

    return run


def _key(shingles: np.ndarray) -> tuple[int, int] | None:
    """128 bits of a hash of a whole set."""
    if not len(shingles):
        return None
    out = []
    for factor in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        h = shingles * np.uint64(factor)
        h ^= h >> np.uint64(32)
        h *= np.uint64(factor)
        h ^= h >> np.uint64(29)
        out.append(int((h.sum(dtype=np.uint64, keepdims=True) * np.uint64(2) + np.bitwise_xor.reduce(h, keepdims=True)).view(np.int64)[0]))
    return out[0], out[1]


def pack(m: np.ndarray) -> np.ndarray:
    """The low bits of minima, packed into 64-bit words."""
    low = (m & np.uint32((1 << LOW_BITS) - 1)).astype(np.uint64).reshape(len(m), m.shape[1] * LOW_BITS // 64, 64 // LOW_BITS)
    return (low << (np.arange(low.shape[2], dtype=np.uint64) * np.uint64(LOW_BITS))).sum(axis=2, dtype=np.uint64)


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, one, two, texts = columns(batch, "node", "key", "key2", "text")
            keys = list(zip(one, two, strict=True))
            for i, j in slices([len(x or "") for x in texts], CHUNK):
                got = [(node, s) for node, key, s in zip(nodes[i:j], keys[i:j], shingle_sets(texts[i:j], width), strict=True) if _key(s) == key]
                signs = pack(minima([s for _, s in got], CLOSER)).view(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([s.view(np.int64) for _, s in got], pa.list_(pa.int64())), pa.array([s.astype(np.uint32).view(np.int32) for _, s in got], pa.list_(pa.int32())), pa.array(signs, pa.list_(pa.int64()))], ["node", "shingles", "brief", "signature"])

    return run


def common(owner: np.ndarray, values: np.ndarray, us: np.ndarray, vs: np.ndarray) -> np.ndarray:
    """How many values rows us and rows vs share, by products of incidence matrices. owner: the row of each value."""
    _, ids, n = np.unique(values, return_inverse=True, return_counts=True)
    new = np.cumsum(n > 1) - 1
    keep = n[ids] > 1
    owner, ids = owner[keep], new[ids[keep]]
    out = np.zeros((len(us), len(vs)), np.float32)
    place = [np.full(int(max(us.max(), vs.max(), owner.max(initial=0))) + 1, -1) for _ in range(2)]
    place[0][us], place[1][vs] = np.arange(len(us)), np.arange(len(vs))
    for k in range(0, int(ids.max(initial=-1)) + 1, WIDE):
        here = (ids >= k) & (ids < k + WIDE)
        sides = []
        for at, size in zip(place, (len(us), len(vs)), strict=True):
            m = np.zeros((size, WIDE), np.float32)
            row = at[owner[here]]
            m[row[row >= 0], ids[here][row >= 0] - k] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _meetings(per_cent: int):
    """Of the rows of a cell (one part of a bucket, or two): links that join nodes of different components, no more than
    that takes."""
    half, chance = np.uint64(0x5555555555555555), 1 / (1 << LOW_BITS)
    most = (1 - chance - (per_cent / 100 - MARGIN) * (1 - chance)) * CLOSER

    def links(rows: pa.StructArray) -> list[tuple[int, int]]:
        side, node, component, signature, brief = rows.flatten()
        side, node, component = (x.to_numpy() for x in (side, node, component))
        if len(np.unique(component)) < 2:
            return []
        sign = signature.flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        size, values = pc.list_value_length(brief).to_numpy(), brief.flatten().to_numpy()
        xs = np.flatnonzero(side == 0)
        ys = np.flatnonzero(side == 1) if (side == 1).any() else xs
        maybe = (component[xs, None] != component[ys]) & (size[xs, None] * 100 >= per_cent * size[ys]) & (size[ys] * 100 >= per_cent * size[xs, None])
        for i in range(0, len(xs), 64):
            wrong = np.zeros(maybe[i : i + 64].shape, np.int64)
            for w in range(sign.shape[1]):
                off = sign[xs[i : i + 64], w, None] ^ sign[ys, w]
                wrong += np.bitwise_count((off | (off >> np.uint64(1))) & half)
            maybe[i : i + 64] &= wrong <= most
        us, vs = xs[maybe.any(axis=1)], ys[maybe.any(axis=0)]
        if not len(us):
            return []
        shared = common(np.repeat(np.arange(len(node)), size), values, us, vs)
        near = maybe[np.ix_(maybe.any(axis=1), maybe.any(axis=0))] & (shared * 100 >= per_cent * (size[us, None] + size[vs] - shared))
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while (d := joined.get(c, c)) != c:
                c = d
            return c

        out = []
        for u, v in np.argwhere(near).tolist():
            a, b = root(int(component[us[u]])), root(int(component[vs[v]]))
            if a != b:
                joined[max(a, b)] = min(a, b)
                out.append((int(node[us[u]]), int(node[vs[v]])))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0)
            for k in range(len(cells)):
                pairs = links(cells.slice(k, 1).flatten())
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])

    return run


def _keyed(width: int):
    """Of batches with text: the key of its set, and the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = columns(batch, "text")
            for i, j in slices([len(x or "") for x in texts], CHUNK):
                keys = [_key(s) for s in shingle_sets(texts[i:j], width)]
                yield pa.RecordBatch.from_arrays([*(pa.array([x and x[k] for x in keys], pa.int64()) for k in (0, 1)), pa.array(texts[i:j], pa.string())], ["key", "key2", "text"])

    return run


def estimate(a: str, b: str) -> Column:
    """The similarity that two packed signatures tell, without the share of low bits that agree by chance."""
    half = F.lit(0x5555555555555555)
    off = [F.col(a)[k].bitwiseXOR(F.col(b)[k]) for k in range(CLOSER * LOW_BITS // 64)]
    wrong = sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(half)) for x in off[1:]), F.bit_count(off[0].bitwiseOR(F.shiftrightunsigned(off[0], 1)).bitwiseAND(half)))
    chance = 1 / (1 << LOW_BITS)
    return ((1 - wrong / CLOSER) - chance) / (1 - chance)


def _numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with a number each, from 0 in order of doc, those without one first: heads of buckets are the oldest."""
    raw = stored(nodes.repartitionByRange("doc", "key").sortWithinPartitions("doc", "key").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33)
    # A row for each partition.
    n = raw.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    ahead = cut(n.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead")))
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return raw.withColumn("part", part).join(F.broadcast(ahead), "part").withColumn("node", inside + F.col("ahead")).drop("part", "at", "ahead")


def _wider(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) once more links (a, b) join them."""
    if links.isEmpty():
        return joined
    return components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = PER_CENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, group_id.

    A document's set are its distinct runs of width words (A-Z in small letters, cut at ASCII white space); with fewer
    words, all of them as one. Documents link if 100 * common >= per_cent * together. component_id: the smallest doc_id
    reachable over links; kept: whether that is its own. group_id: any number of its component, null without words.

    Sets with equal 128-bit keys become one node, numbered. Nodes that share a band of their MinHash minima are
    candidates. In each bucket all nodes are compared with one, over full sets, if their b-bit signatures don't rule it
    out; where the links' components leave a bucket with several, its nodes are compared with another one, and so on;
    what is left of a bucket is cut into parts that meet two by two (over 32-bit hashes; links are confirmed once more on
    full sets), and only links that join components leave a meeting. So a bucket of copies gives about a link for each,
    not one for each pair, and no link between components is missed. Rows of a large bucket are dealt in parts.

    Null, empty and blank texts: no shingles, linked with nothing, kept. A row with a null doc_id links as any other and
    carries links on; its component_id is the others' smallest id, or null, and it isn't kept. Repeated rows share their
    id and component and are all kept, or none. No rows: none. Other columns are ignored, but for those of carry, which
    the result has too (any but those named above, key, key2, bands and text).
    """
    kept = docs.select("doc_id", *carry, "text")
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in kept.columns[:-1])
    sketch = stored(kept.mapInArrow(_sketcher(width), f"{kinds}, n_shingles long, key long, key2 long, bands array<long>"))
    nodes = sketch.where("key is not null").groupBy("key", "key2").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = _numbered(nodes)
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    shared = stored(buckets.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1"))
    parts = F.ceil(F.col("size") / SPLIT).cast("int")
    members = stored(buckets.join(shared, "band").select("band", "node", "head", parts.alias("salts")).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")))

    def salted(of_band: DataFrame) -> DataFrame:
        """A row of a bucket (band, salts), once for each of its parts."""
        return of_band.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    asked = nodes.select("node", "doc", "key", "key2").join(members.select("node").distinct(), "node", "left_semi")
    texts = docs.select("doc_id", "text")
    named = texts.join(asked.select(F.col("doc").alias("doc_id"), "node", "key", "key2"), "doc_id").select("node", "key", "key2", "text")
    unnamed = texts.where("doc_id is null").select("text").mapInArrow(_keyed(width), "key long, key2 long, text string").join(asked.where("doc is null").select("key", "key2", "node"), ["key", "key2"]).select("node", "key", "key2", "text")
    sets = stored(named.unionByName(unnamed).mapInArrow(_sets(width), "node long, shingles array<long>, brief array<int>, signature array<long>").dropDuplicates(["node"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that link; a may stand in many."""
        dealt = pairs.select("a", "b", F.pmod(F.hash("b"), F.lit(SALTS)).alias("salt"))
        one = dealt.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        two = dealt.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        both = two.join(one, ["a", "salt"]).withColumn("common", F.size(F.array_intersect("sa", "sb")))
        return cut(both.where(F.col("common") * 100 >= per_cent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b"))

    signed = sets.select("node", F.size("shingles").alias("n"), "signature")
    sides = [signed.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}")) for x in "ab"]
    likely = (F.col("na") * 100 >= per_cent * F.col("nb")) & (F.col("nb") * 100 >= per_cent * F.col("na")) & (estimate("sa", "sb") >= per_cent / 100 - MARGIN)
    stars = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    # A component's nodes, linked with its smallest, stand for the links that they were found by.
    joined = components(confirmed(stars.join(sides[0], "a").join(sides[1], "b").where(likely)))
    turn, before = 0, float("inf")
    while True:
        # Buckets in which several components meet; a component's nodes needn't meet each other again.
        placed = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("salts").alias("salts")).where("low < high").select("band", "salts")
        meet = cut(placed.join(salted(mixed), ["band", "salt"]))
        each = meet.groupBy("band", "component").agg(F.count("*").alias("k")).groupBy("band").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"))
        rows, pairs = each.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum((F.col("k") * F.col("k") - F.col("same")) / 2), F.lit(0))).first()
        if pairs <= FEW * rows or pairs > SHRINK * before:
            break
        turn, before = turn + 1, pairs
        first = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "component")
        heads = meet.groupBy("band").agg(F.min(first).alias("f"), F.max("salts").alias("salts")).select("band", "salts", F.col("f.node").alias("a"), F.col("f.component").alias("ca"))
        again = meet.join(salted(heads), ["band", "salt"]).where(F.col("component") != F.col("ca")).select("a", F.col("node").alias("b")).distinct()
        joined = _wider(joined, confirmed(again.join(sides[0], "a").join(sides[1], "b").where(likely)))
    sized = meet.join(sets.select("node", F.size("brief").alias("n")), "node").groupBy("band").agg(F.greatest(F.ceil(F.count("*") / SQUARE), F.ceil(F.sum("n") / FULL)).cast("int").alias("parts"), F.max("salts").alias("salts"))
    # Parts are found on narrow rows; sets come to them afterwards, and are shuffled once more, to their cells.
    placed = meet.select("band", "salt", "node", "component").join(salted(sized), ["band", "salt"]).withColumn("part", F.pmod(F.hash("node"), F.col("parts"))).drop("salt")
    dealt = placed.join(sets.select("node", "signature", "brief"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    row = F.struct((F.col("part") > F.col("other")).cast("int").alias("side"), "node", "component", "signature", "brief")
    cells = dealt.groupBy("band", F.least("part", "other"), F.greatest("part", "other")).agg(F.collect_list(row).alias("rows")).select("rows")
    found = cut(cells.mapInArrow(_meetings(per_cent), "a long, b long").distinct())
    final = _wider(joined, confirmed(found))
    of_node = nodes.select("key", "key2", "node", "doc").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = of_node.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_key = of_node.join(ids, "component").select("key", "key2", "component_id", F.col("component").alias("group_id"))
    own = ["doc_id", *carry, "n_shingles", "component_id", "group_id"]
    empty = sketch.where("key is null").withColumn("component_id", F.col("doc_id")).withColumn("group_id", F.lit(None).cast("long")).select(*own)
    every = sketch.where("key is not null").join(of_key, ["key", "key2"]).select(*own).unionByName(empty)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
