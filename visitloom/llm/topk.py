"""Exact top-k inner products by an impact-ordered, score-at-a-time index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import stored

#: About so many components make a block of the index, so many vectors at most; and so many scores are held at a time.
CELLS, BLOCK, SCORES = 1 << 20, 1 << 13, 1 << 21
#: Components of queries that are sent to all tasks at a time: 8 bytes each.
ROUND = 1 << 22
#: Shares of a block's largest impact down to which each segment of postings goes.
STEPS = (0.5, 0.25, 0.1, 0.04, 0.0)
#: Once at most this share of a block may still belong to a query's answer, it is scored exactly.
FEW = 0.02
#: Norms of queries and vectors below which their products are exact in 64-bit floats.
SMALL = (2.0**26, 2.0**26)


def whole(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and floor(256 * x) of a batch's vectors (vec_id, embedding), those of one length at a time, at most a block."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        step = max(1, min(BLOCK, CELLS // width))
        for i in range(0, len(at), step):
            rows = at[i : i + step]
            values = np.floor(lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) * 256)
            if not np.isfinite(values).all():
                raise OverflowError("a component times 256 is no 64-bit float")
            yield ids[rows], values


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks: ids in order, and the postings (place, dimension, impact) by falling size of the impact."""
    for batch in batches:
        for ids, values in matrices(batch):
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
            flat = values.ravel()
            fall = np.argsort(-np.abs(flat), kind="stable").astype(np.int32)
            fall = fall[: np.count_nonzero(flat)]
            impacts = flat[fall]
            narrow = impacts.astype(np.int16) if len(impacts) and abs(impacts[0]) < 1 << 15 else impacts
            made = [[values.shape[1]], [ids.astype(np.int64).tobytes()], [fall.tobytes()], [narrow.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["width", "ids", "postings", "impacts"])


class Block:
    """A block of the index, and its segments: postings down to each of STEPS."""

    def __init__(self, width: int, ids: bytes, postings: bytes, impacts: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        n = len(self.ids)
        at = np.frombuffer(postings, np.int32)
        sizes = np.frombuffer(impacts, np.int16 if len(impacts) == 2 * len(at) else np.float64).astype(np.float64)
        self.values = np.zeros((n, width))
        self.values.ravel()[at] = sizes
        self.norm = np.sqrt((self.values**2).sum(axis=1))
        falling = np.abs(sizes)
        top = falling[0] if len(falling) else 0.0
        self.segments: list[tuple[slice, np.ndarray, float]] = []
        begin, left = 0, self.norm**2
        for step in STEPS:
            end = int(np.searchsorted(-falling, -top * step, side="right")) if step else len(at)
            row = at[begin:end] // width
            left = left - np.bincount(row, sizes[begin:end] ** 2, n)
            # What a vector hasn't shown has this norm at most, and no component of this size.
            self.segments.append((slice(begin, end), np.sqrt(np.maximum(left, 0.0)) if step else np.zeros(n), top * step))
            begin = end
        self.at, self.sizes = at, sizes

    def segment(self, k: int) -> np.ndarray:
        out = np.zeros_like(self.values)
        part = self.segments[k][0]
        out.ravel()[self.at[part]] = self.sizes[part]
        return out


def exact_few(query: np.ndarray, values: np.ndarray) -> list[int]:
    """Inner products of any size, by Python's whole numbers."""
    q = [int(x) for x in query]
    return [sum(a * int(b) for a, b in zip(q, v, strict=True)) for v in values]


class Answers:
    """The k best of each query among the blocks that a task has met."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.norm, self.sum = np.sqrt((queries**2).sum(axis=1)), np.abs(queries).sum(axis=1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def add(self, i: int, scores: Iterable[int], ids: Iterable[int]) -> None:
        held = sorted(self.best[i] + [(-int(s), int(v)) for s, v in zip(scores, ids, strict=True)])[: self.k]
        if held and not -(1 << 63) <= -held[0][0] < 1 << 63:
            raise OverflowError("a score doesn't fit 64 bits")
        self.best[i] = held
        if len(held) == self.k:
            self.least[i] = float(-held[-1][0])

    def meet(self, block: Block) -> None:
        width = min(self.queries.shape[1], block.values.shape[1])
        plain, fits = block.norm < SMALL[1], self.norm < SMALL[0]
        odd = np.flatnonzero(~plain)
        step = max(1, SCORES // max(1, len(block.ids)))
        easy = np.flatnonzero(fits)
        for a in range(0, len(easy), step):
            self._sweep(easy[a : a + step], block, width, plain)
        for some, rows in ((easy, odd), (np.flatnonzero(~fits), np.arange(len(block.ids)))):
            for i in some.tolist() if len(rows) else ():
                own = rows[block.ids[rows] != self.ids[i]]
                self.add(i, exact_few(self.queries[i, :width], block.values[own, :width]), block.ids[own])

    def _sweep(self, some: np.ndarray, block: Block, width: int, plain: np.ndarray) -> None:
        """Segments by falling impact for many queries at once; a query leaves once few vectors may still be in its answer.

        A vector's score is what it has gathered and what it hasn't shown; that is at most the product of its norm and the
        query's, and of the largest impact left and the query's sum. The answer's last score is no lower than the k-th of
        any k vectors scored exactly.
        """
        n, k = len(block.ids), self.k
        queries = self.queries[some, :width]
        barred = ~plain[None, :] | (block.ids[None, :] == self.ids[some, None])
        gathered = np.zeros((len(some), n))
        active = np.arange(len(some))
        for level, (_, rest, size) in enumerate(block.segments):
            last = level == len(block.segments) - 1
            gathered[active] += queries[active] @ block.segment(level)[:, :width].T
            most = gathered[active]
            most[barred[active]] = -np.inf
            if n > k:
                likely = np.argpartition(-most, k - 1, axis=1)[:, :k]
                sure = np.einsum("qkd,qd->qk", block.values[likely, :width], queries[active])
                sure[np.take_along_axis(barred[active], likely, 1)] = -np.inf
                floor = np.maximum(self.least[some[active]], sure.min(axis=1))
            else:
                floor = self.least[some[active]]
            most += np.minimum(self.norm[some[active], None] * rest, self.sum[some[active], None] * size) * (1 + 1e-9)
            possible = (most >= floor[:, None]) & ~barred[active]
            done = possible.sum(axis=1) <= (n if last else FEW * n)
            for j in np.flatnonzero(done).tolist():
                self._rescore(int(some[active[j]]), queries[active[j]], np.flatnonzero(possible[j]), block)
            active = active[~done]
            if not len(active):
                return

    def _rescore(self, i: int, query: np.ndarray, rows: np.ndarray, block: Block) -> None:
        scores = block.values[rows, : len(query)] @ query
        if len(rows) > self.k:  # ids stand in order, so of ties the first belong to the answer
            least = np.partition(scores, len(rows) - self.k)[len(rows) - self.k]
            keep = np.concatenate([np.flatnonzero(scores > least), np.flatnonzero(scores == least)[: self.k]])
            rows, scores = rows[keep], scores[keep]
        self.add(i, scores.tolist(), block.ids[rows].tolist())


def _searcher(asked, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(*asked.value, k)
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("width", "ids", "postings", "impacts")), strict=True):
                answers.meet(Block(row[0].as_py(), *(x.as_buffer() for x in row[1:])))
        rows = [(int(q), v, -s) for q, held in zip(answers.ids, answers.best, strict=True) for s, v in held]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], []))], ["query_id", "vec_id", "score"])

    return run


def _side_by_side(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of queries, the shorter ones filled up with zeros."""
    parts = [p for batch in rows.combine_chunks().to_batches() for p in matrices(batch)]
    width = max((v.shape[1] for _, v in parts), default=1)
    wide = [np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in parts]
    return np.concatenate([i for i, _ in parts] or [np.zeros(0, np.int64)]).astype(np.int64), np.concatenate(wide or [np.zeros((0, width))])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k highest integer inner products of each query with the vectors: query_id, rank, vec_id, score.

    vectors, queries: vec_id, embedding. A vector doesn't meet the query with its own id. Components are quantised to
    floor(256 * x). Ties go to the smaller vec_id; repeated rows each take a rank. Null vectors and ids, empty vectors
    and those with a null or non-finite component take no part. Vectors of different lengths are filled up with zeros.
    With fewer than k vectors all are returned; without any, none. Large components are multiplied exactly, one pair at a
    time; a component beyond 64-bit floats when multiplied by 256, or an answer beyond 64-bit integers, is an error.
    Other columns are ignored.

    Vectors are indexed once, in blocks, which are written. Each round sends a bounded number of queries (ROUND
    components) to all tasks; these read the blocks in turn, and what a task has found so far ends the work on its next
    block earlier. So the index is read once a round and never shuffled; k rows a query leave each task.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        return df.where(whole(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    n = vectors.count()
    tasks = max(1, ceil(n / BLOCK), min(ceil(n / 1024), spark.sparkContext.defaultParallelism))
    index = stored(usable(vectors).repartition(tasks).mapInArrow(_index, "width int, ids binary, postings binary, impacts binary"))
    asked = usable(queries)
    cells = asked.agg(F.sum(F.size("embedding").cast("long")), F.max(F.size("embedding")), F.count("*")).first()
    rounds = max(1, ceil((cells[1] or 0) * cells[2] / ROUND))
    if rounds > 1:
        asked = stored(asked.withColumn("round", F.pmod(F.monotonically_increasing_id(), F.lit(rounds))))
    parts = []
    for r in range(rounds):
        here = asked.where(F.col("round") == r).select("vec_id", "embedding") if rounds > 1 else asked
        sent = spark.sparkContext.broadcast(_side_by_side(here.toArrow()))
        found = index.mapInArrow(_searcher(sent, k), "query_id long, vec_id long, score long")
        parts.append(stored(found) if rounds > 1 else found)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return every.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = 5, every: int = 50) -> str:
    """The same in DuckDB's SQL, over the table embeddings, for queries whose vec_id is divisible by every."""
    return f"""
    with v as (
      select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
      where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
    select query_id, rank::int as rank, vec_id, score from (
      select q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint score,
        row_number() over (partition by q.vec_id order by list_dot_product(q.v, c.v) desc, c.vec_id) as rank
      from v q join v c on q.vec_id % {every} = 0 and c.vec_id <> q.vec_id)
    where rank <= {k}"""
