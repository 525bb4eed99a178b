"""Clusters of vectors by cosine distance, for owners of any size; connected components; speakers' profiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.functions.scores import dot, l2
from visitloom.operators.lineage import kept

#: Vectors of an owner that are linked by average distance, in one task; those of larger owners are linked one to one.
LOCAL = 512
#: About so many vectors make a block, so many blocks a side of what meets in a task; ranges of a projection.
BLOCK, SIDE, RANGES = 2048, 8, 64


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node reachable.

    Each round points every node to its smallest smaller neighbour, follows the pointers to their ends by doubling, and
    lets the edges join the ends. What points nowhere has a neighbour that points to it, so rounds at least halve the
    nodes; only whether edges are left comes to the driver.
    """
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    out = kept(now.select(F.col("u").alias("node")).union(now.select("v")).distinct().withColumn("component", F.col("node")))
    while not now.isEmpty():
        up = kept(now.groupBy("u").agg(F.min("v").alias("to")))
        while True:
            far = up.join(up.select(F.col("u").alias("to"), F.col("to").alias("next")), "to", "left")
            up = kept(far.select("u", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        ends = up.select(F.col("u").alias("x"), F.col("to").alias("end"))
        out = kept(out.join(ends, F.col("component") == F.col("x"), "left").select("node", F.coalesce("end", "component").alias("component")))
        one = now.join(ends, F.col("u") == F.col("x"), "left").select(F.coalesce("end", "u").alias("u"), "v")
        both = one.join(ends, F.col("v") == F.col("x"), "left").select("u", F.coalesce("end", "v").alias("v"))
        now = kept(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return out


def average_linkage(vectors: np.ndarray, most: float) -> list[list[int]]:
    """Unit vectors merged, nearest clusters first, while their mean distance is at most most; of equal ones the first."""
    groups, far = [[i] for i in range(len(vectors))], 1 - vectors @ vectors.T
    size = np.ones(len(vectors))
    far[np.tril_indices(len(far))] = np.inf
    while len(far) > 1:
        i, j = divmod(int(far.argmin()), len(far))
        if far[i, j] > most:
            break
        whole = np.minimum(far, far.T)
        row = (size[i] * whole[i] + size[j] * whole[j]) / (size[i] + size[j])
        far[i, i + 1 :], far[:i, i] = row[i + 1 :], row[:i]
        size[i] += size[j]
        groups[i] += groups[j]
        groups[j], far[j, :], far[:, j] = [], np.inf, np.inf
    return [g for g in groups if g]


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
    """Gives rows a and b that are linked, and all that share a label with them, the smaller label."""
    while True:
        pairs: set[tuple[int, int]] = set()
        for rows, others, m in ((a, b, linked), (b, a, linked.T)):
            least = np.where(m, labels[others][None, :], len(labels)).min(axis=1)
            some = least < np.minimum(labels[rows], len(labels))
            pairs.update(zip(labels[rows[some]].tolist(), least[some].tolist(), strict=True))
        if not pairs:
            return
        to = np.arange(len(labels))

        def end(x: int) -> int:
            while to[x] != x:
                x = to[x] = to[to[x]]
            return x

        for x, y in pairs:
            x, y = end(x), end(y)
            to[max(x, y)] = min(x, y)
        for x, _ in pairs:
            to[x] = end(x)
        labels[:] = to[labels]


def _linker(most: float):
    """Links of a group of blocks: each row with the smallest of those in the group that it hangs together with."""
    least = 1 - most

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, v, blocks = [], [], []
        for block, listed in sorted(zip(rows["block"].to_pylist(), rows["rows"].combine_chunks(), strict=True)):
            own = listed.values
            held = own.field("id").to_numpy(zero_copy_only=False)
            blocks.append((block, np.arange(len(held)) + sum(map(len, ids))))
            ids.append(held)
            v.append(own.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1))
        ids, v = np.concatenate(ids), np.concatenate(v)
        labels, n = np.arange(len(ids)), rows["side"].to_numpy()
        sides = dict(zip(rows["block"].to_pylist(), n.tolist(), strict=True))
        same = key[1].as_py() == key[2].as_py()
        for i, (one, a) in enumerate(blocks):
            for other, b in blocks[i:] if same else blocks[i + 1 :]:
                if not same and sides[one] == sides[other]:
                    continue
                if (labels[a] == labels[a[0]]).all() and (labels[b] == labels[a[0]]).all():
                    continue
                _joined(labels, a, b, v[a] @ v[b].T >= least)
        smallest = np.full(len(ids), ids.max())
        np.minimum.at(smallest, labels, ids)
        moved = ids != smallest[labels]
        owner = pa.array([key[0].as_py()] * int(moved.sum()), rows["owner"].type)
        return pa.table({"owner": owner, "a": ids[moved], "b": smallest[labels][moved]})

    return run


def _chained(unit: DataFrame, most: float) -> DataFrame:
    """Links (owner, a, b) that hold together what a chain of distances of at most most connects.

    Vectors within that distance have projections on any direction that differ by at most the chord of the angle; so an
    owner's vectors are dealt to ranges of their projection on one of them, ranges to blocks, and groups of blocks meet
    where their ranges are near enough. Of what hangs together already nothing is compared again, and each meeting leaves
    a row a vector at most.
    """
    pivot = unit.groupBy("owner").agg(F.min_by("v", "id").alias("p"))
    t = F.least(F.greatest(F.floor((dot(F.col("v"), F.col("p")) + 1) / 2 * RANGES), F.lit(0)), F.lit(RANGES - 1))
    dealt = kept(unit.join(pivot, "owner").select("owner", "id", "v", t.alias("range")))
    cuts = dealt.groupBy("owner", "range").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    parted = dealt.join(cuts, ["owner", "range"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = parted.groupBy("owner", "range", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    # A block's number within its owner: blocks are few, and their rows stay where they are until they meet.
    numbered = kept(packed.select("owner", "range", "part", "rows"))
    nth = F.row_number().over(Window.partitionBy("owner").orderBy("range", "part")) - 1
    index = numbered.select("owner", "range", "part").withColumn("block", nth).withColumn("group", F.floor(F.col("block") / SIDE))
    spans = index.groupBy("owner", "group").agg(F.min("range").alias("low"), F.max("range").alias("high"))
    reach = math.sqrt(max(0.0, 2 * most)) * RANGES / 2 + 1
    one, other = spans.select("owner", F.col("group").alias("g"), F.col("high").alias("upto")), spans.select("owner", F.col("group").alias("h"), "low")
    cells = one.join(other, "owner").where((F.col("g") <= F.col("h")) & (F.col("low") - F.col("upto") <= reach)).select("owner", "g", "h")
    sent = cells.select("*", F.col("g").alias("group")).unionByName(cells.where("g <> h").select("*", F.col("h").alias("group")))
    rows = numbered.join(index, ["owner", "range", "part"]).join(sent, ["owner", "group"])
    kind = unit.schema["owner"].dataType.simpleString()
    return rows.select("owner", "g", "h", F.col("group").alias("side"), "block", "rows").groupBy("owner", "g", "h").applyInArrow(_linker(most), f"owner {kind}, a long, b long")


def link_clusters(vectors: DataFrame, owner: str, most: float = 0.65) -> DataFrame:
    """Clusters of an owner's vectors by cosine distance: owner, id, cluster (its smallest id).

    Owners of at most LOCAL vectors: average linkage, merging the nearest clusters while their mean distance is at most
    most. Larger ones: single linkage, so whatever a chain of such distances connects is a cluster; their vectors meet in
    blocks, and the links' components are found over all tasks. Rows with a null owner, id or vector take no part.
    """
    usable = vectors.where(F.col(owner).isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull())
    unit = usable.select(F.col(owner).alias("owner"), F.col("id").cast("long").alias("id"), l2(F.col("v")).alias("v"))
    sizes = kept(unit.groupBy("owner").agg(F.count("*").alias("n")))
    kind = unit.schema["owner"].dataType.simpleString()

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids = rows["id"].to_numpy()
        groups = average_linkage(np.stack(rows["v"].to_list()), most)
        return pd.DataFrame([(rows["owner"].iloc[0], ids[k], ids[min(g)]) for g in groups for k in g], columns=["owner", "id", "cluster"])

    small = unit.join(sizes.where(F.col("n") <= LOCAL), "owner", "left_semi").groupBy("owner").applyInPandas(link, f"owner {kind}, id long, cluster long")
    large = sizes.where(F.col("n") > LOCAL)
    if not large.isEmpty():
        of = unit.join(large, "owner", "left_semi")
        links = _chained(of, most)
        found = components(links.select(F.struct("owner", F.col("a").alias("id")).alias("a"), F.struct("owner", F.col("b").alias("id")).alias("b")))
        whole = of.select("owner", "id").join(found.select("node.*", F.col("component.id").alias("cluster")), ["owner", "id"], "left")
        small = small.unionByName(whole.select("owner", "id", F.coalesce("cluster", "id").alias("cluster")))
    return small.withColumnRenamed("owner", owner)


def _mean(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The mean vector of each group, as a unit vector; dimensions are averaged where the rows are first."""
    long = rows.select(*keys, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    listed: Column = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return long.groupBy(*keys).agg(l2(listed).alias("prototype"))


def speaker_profile(vectors: DataFrame, most: float = 0.65, near: float = 0.35, prototypes: int = 4) -> DataFrame:
    """Of each owner the speaker who recurs: owner, cluster, recordings, size, nth, n, prototype.

    vectors: owner, id, v, recording. Of an owner's clusters the one in most different recordings counts, two at least;
    ties to the larger, then to the smaller id. It has up to so many prototypes, unit vectors: of a cluster no larger its
    own vectors, else the means of its closer clusters (distance near), largest first; n is how many vectors they stand
    for. Owners without such a cluster have no rows.
    """
    clusters = link_clusters(vectors, "owner", most)
    rows = kept(vectors.select("owner", "id", "recording", l2(F.col("v")).alias("v")).join(clusters, ["owner", "id"]))
    per = rows.groupBy("owner", "cluster").agg(F.count_distinct("recording").alias("recordings"), F.count("*").alias("size")).where("recordings >= 2")
    best = kept(per.groupBy("owner").agg(F.max_by(F.struct("cluster", "recordings", "size"), F.struct("recordings", "size", -F.col("cluster"))).alias("b")).select("owner", "b.*"))
    members = rows.join(best, ["owner", "cluster"])
    closer = link_clusters(members.where(F.col("size") > prototypes).select("owner", "id", "v"), "owner", near).withColumnRenamed("cluster", "sub")
    parts = members.join(closer, ["owner", "id"], "left").withColumn("sub", F.coalesce("sub", "id"))
    sizes = parts.groupBy("owner", "sub").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("owner").orderBy(F.col("n").desc(), "sub"))
    chosen = sizes.withColumn("nth", nth).where(F.col("nth") <= prototypes)
    means = _mean(parts.join(chosen, ["owner", "sub"]).select("owner", "sub", "v"), ["owner", "sub"])
    return best.join(chosen.join(means, ["owner", "sub"]), "owner").select("owner", "cluster", "recordings", "size", "nth", "n", "prototype")


