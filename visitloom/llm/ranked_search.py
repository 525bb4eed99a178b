"""Ranked lexical search by treaps over quadtrees of the grid of terms and documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import columns, stored

#: Documents, and about so many postings, that one grid covers at most.
DOCS, POSTINGS = 1 << 12, 1 << 20
#: Terms of items that are sent to all tasks at a time, counted once an item.
ROUND = 1 << 20
#: Document ranges that an item opens at a time, those of the highest bounds.
WIDE = 96
#: Bytes to the lower-case letter, digit or byte beyond ASCII that they are in a term, or to a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: How many of four bits are set.
BITS = np.array([bin(i).count("1") for i in range(16)], np.int32)


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [sorted(set(terms(t))) for t in _texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.binary()))], ["item_id", "terms"])


def _counter(sent):
    """Documents as their ids, lengths, and those of the terms asked for with how often each occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(sent.value)}
        for batch in batches:
            ids, sizes, held, times = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch), strict=True):
                if not (found := terms(text)):
                    continue
                counts = Counter(map(number.get, found))
                counts.pop(None, None)
                ids.append(doc_id)
                sizes.append(len(found))
                held.append(np.fromiter(counts.keys(), np.int32, len(counts)).tobytes())
                times.append(np.fromiter(counts.values(), np.int32, len(counts)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, sizes, held, times), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "n", "terms", "times"])

    return run


def _holders(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting adds to a score; n: the length of its document."""
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 63:
        m = 10 + 90 * n * n_docs // n_terms
    else:
        m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    tf = tf.astype(np.int64)
    return weights * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2^31, each with a gap before the next."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << shift) & mask
    return x


class Treap:
    """A quadtree over the grid of terms (rows) and documents (columns) that has cells only where there are postings.

    Cells of all levels stand in one list, those of a level by their place along the Z-shaped curve. A cell has the
    largest impact in it, a bit for each quarter that isn't empty, and where its first quarter stands; the number of bits
    before a quarter's finds that quarter. Cell 0 is empty.
    """

    def __init__(self, rows: np.ndarray, docs: np.ndarray, values: np.ndarray, n_rows: int, n_docs: int):
        self.height = max(int(n_rows - 1).bit_length(), int(n_docs - 1).bit_length(), 1)
        codes = _spread(rows) << 1 | _spread(docs)
        order = np.argsort(codes, kind="stable")
        codes, values = codes[order], values[order]
        every, masks, firsts, begin = [np.zeros(1, np.int64), values], [np.zeros(1 + len(codes), np.uint8)], [np.zeros(1 + len(codes), np.int32)], 1
        for _ in range(self.height):
            if not len(codes):
                break
            at = np.flatnonzero(np.concatenate([[True], codes[1:] >> 2 != codes[:-1] >> 2]))
            masks.append(np.bitwise_or.reduceat((1 << (codes & 3)).astype(np.uint8), at))
            firsts.append((at + begin).astype(np.int32))
            begin += len(codes)
            codes, values = codes[at] >> 2, np.maximum.reduceat(values, at)
            every.append(values)
        self.value, self.mask, self.first = np.concatenate(every), np.concatenate(masks), np.concatenate(firsts)
        self.root = len(self.value) - 1 if len(codes) else 0

    def best(self, rows: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores): every document that may be among the k with the highest sums over rows, none below floor.

        A range of documents has one cell for each row, on the row's path; the sum of their largest impacts bounds the
        scores in it. Ranges of the highest bounds are halved first, all their paths at once, until no bound reaches the
        k-th score known.
        """
        cells = np.full((1, len(rows)), self.root, np.int32)
        begin, level = np.zeros(1, np.int64), np.full(1, self.height, np.int64)
        bound = self.value[cells].sum(axis=1)
        columns, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = max(floor, 1)
        while len(bound):
            if len(bound) > WIDE:
                order = np.argpartition(-bound, WIDE)
                some, rest = order[:WIDE], order[WIDE:]
            else:
                some, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            cell, at = cells[some], level[some] - 1
            half = ((rows[None, :] >> at[:, None]) & 1) << 1
            mask, first = self.mask[cell], self.first[cell]
            new_cells, new_begin, new_level, new_bound = [cells[rest]], [begin[rest]], [level[rest]], [bound[rest]]
            for side in (0, 1):
                quarter = half | side
                below = np.where(mask >> quarter & 1, first + BITS[mask & ((1 << quarter) - 1)], 0).astype(np.int32)
                sums = self.value[below].sum(axis=1)
                place = begin[some] + (side << at)
                leaf = (at == 0) & (sums >= floor)
                if leaf.any():
                    columns, scores = np.concatenate([columns, place[leaf]]), np.concatenate([scores, sums[leaf]])
                inner = (at > 0) & (sums >= floor)
                new_cells.append(below[inner])
                new_begin.append(place[inner])
                new_level.append(at[inner])
                new_bound.append(sums[inner])
            if len(scores) > k:
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= floor
                columns, scores = columns[keep], scores[keep]
            cells, begin, level, bound = np.concatenate(new_cells), np.concatenate(new_begin), np.concatenate(new_level), np.concatenate(new_bound)
            if len(rest):
                keep = bound >= floor
                cells, begin, level, bound = cells[keep], begin[keep], level[keep], bound[keep]
        return columns, scores


def _grids(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, list[bytes], list[bytes]]]:
    """Documents of one grid each: ids, lengths, terms, times."""
    ids, sizes, held, times, n = [], [], [], [], 0
    for batch in batches:
        for row in zip(*columns(batch, "doc_id", "n", "terms", "times"), strict=True):
            if len(ids) == DOCS or (ids and n + len(row[2]) // 4 > POSTINGS):
                yield ids, np.array(sizes, np.int64), held, times
                ids, sizes, held, times, n = [], [], [], [], 0
            for kept, x in zip((ids, sizes, held, times), row, strict=True):
                kept.append(x)
            n += len(row[2]) // 4
    if ids:
        yield ids, np.array(sizes, np.int64), held, times


def _searcher(sent, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, asked, weights = sent.value
        # Terms of like weight stand next to each other, and so do documents of like length: cells' maxima are then near to what is in them.
        place = np.empty(len(weights), np.int64)
        place[np.argsort(weights, kind="stable")] = np.arange(len(weights))
        rows = [place[x] for x in asked]
        answers: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        for ids, sizes, held, times in _grids(batches):
            order = np.argsort(sizes, kind="stable")
            n_each = np.array([len(held[i]) // 4 for i in order])
            term = np.frombuffer(b"".join(held[i] for i in order), np.int32)
            tf = np.frombuffer(b"".join(times[i] for i in order), np.int32)
            column = np.repeat(np.arange(len(order)), n_each)
            treap = Treap(place[term], column, impacts(weights[term], tf, sizes[order][column], n_docs, n_terms), len(weights), len(order))
            for i, row in enumerate(rows):
                known = answers[i]
                found, scores = treap.best(row, -known[-1][0] if len(known) == k else 0, k)
                if len(found):
                    hits = [(-int(s), ids[order[c]] is None, ids[order[c]] or 0) for c, s in zip(found.tolist(), scores.tolist(), strict=True)]
                    answers[i] = sorted(known + hits)[:k]
        out = [(item, None if null else doc, -s) for item, held in zip(items, answers, strict=True) for s, null, doc in held]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], []))], ["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring docs (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of letters, digits and whatever is beyond ASCII in the whole text, A-Z lower-cased. Documents without
    terms (null, empty) aren't counted and never found. Equal scores by ascending doc_id, null last; repeated rows each
    count and take a rank. Rows of items with the same id are one item, those without an id take no part; an item without
    terms, or whose terms no document has, has no rows. Other columns are ignored.

    Terms of a bounded number of items are sent to all tasks at a time (one item's terms whole), which write documents as
    postings of these terms; each round reads all documents. Then grids of at most DOCS documents become treaps, each
    item descends in each, and k rows an item leave each task.
    """
    spark = docs.sparkSession
    wanted = stored(items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_asked, "item_id long, terms array<binary>").where("size(terms) > 0"))
    rounds = max(1, math.ceil((wanted.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0) / ROUND))
    parts = []
    for r in range(rounds):
        here = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).toArrow() if rounds > 1 else wanted.toArrow()
        by_item: dict[int, set[bytes]] = {}
        for item, found in zip(here["item_id"].to_pylist(), here["terms"].to_pylist(), strict=True):
            by_item.setdefault(item, set()).update(found)
        names = sorted(set().union(*by_item.values()))
        number = {t: i for i, t in enumerate(names)}
        postings = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counter(spark.sparkContext.broadcast(names)), "doc_id long, n long, terms binary, times binary"))
        n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(names), np.int64)
        for row in postings.select("terms").mapInArrow(_holders(len(names)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the terms sent
            df[row["term"]] = row["df"]
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        asked = [np.array(sorted(number[t] for t in found), np.int64) for found in by_item.values()]
        sent = spark.sparkContext.broadcast((list(by_item), asked, weights))
        found = postings.mapInArrow(_searcher(sent, n_docs, n_terms or 1, k), "item_id long, doc_id long, score long")
        parts.append(stored(found) if rounds > 1 else found)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return every.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle_sql(k: int = 10) -> str:
    """The same in DuckDB's SQL, over the tables documents and benchmark."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    with d as (select row_number() over () rid, doc_id, {words} words from documents where text is not null),
    sized as (select *, len(words) n from d where len(words) > 0),
    tf as (select rid, any_value(doc_id) doc_id, any_value(n) n, w, count(*) tf from (select rid, doc_id, n, unnest(words) w from sized) group by rid, w),
    totals as (select count(*) docs, sum(n)::bigint terms from sized),
    weights as (select w, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint weight from tf, totals group by w),
    asked as (select distinct item_id, unnest({words}) w from benchmark where item_id is not null),
    scored as (
      select item_id, rid, any_value(doc_id) doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint score
      from asked join tf using (w) join weights using (w), totals group by item_id, rid)
    select item_id, rank::int as rank, doc_id, score from (
      select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scored where score > 0)
    where rank <= {k}"""
