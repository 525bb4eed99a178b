"""Improbable-feature digests: byte windows picked by rarity, in chained Bloom filters, compared by bit overlap."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import columns

#: Bytes of a window; a window is picked if it is the rarest of those that begin up to REACH bytes before or after it.
WIDTH, REACH = 64, 32
#: The same two in texts of under SHORT bytes, which have these windows as well.
FINE_WIDTH, FINE_REACH, SHORT = 8, 4, 1024
#: Bits of a Bloom filter, features until the next of the chain begins, bits that a feature sets.
BITS, FULL, HASHES = 2048, 160, 5
#: Where a null id stands.
LEAST = -(1 << 63)
MULTIPLIERS = (np.arange(1, 17, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(65536, np.int64)
    for batch in batches:
        for text in columns(batch, "text")[0]:
            data = np.frombuffer((text or "").encode(), np.uint8)
            for i in range(0, max(0, len(data) - 1), 1 << 20):
                part = data[i : i + (1 << 20) + 1].astype(np.uint16)
                n += np.bincount(part[:-1] << 8 | part[1:], minlength=65536)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["pair", "n"])


def surprise(docs: DataFrame) -> np.ndarray:
    """Of each byte after each byte: -log2 of its share over all texts, in steps of 1/16 bit. At most 65,536 rows."""
    rows = docs.select("text").mapInArrow(_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(65536, np.float64)
    n[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    n = n.reshape(256, 256)
    return np.round(-16 * np.log2((n + 1) / (n.sum(axis=1, keepdims=True) + 256))).astype(np.int32).ravel()


class Digest:
    """A chain of Bloom filters, as rows of bits."""

    def __init__(self, data: bytes, bits_of: np.ndarray):
        features = _features(data, bits_of)
        self.n = len(features)
        chain = np.arange(self.n) // FULL
        self.filters = np.zeros((int(chain[-1]) + 1 if self.n else 0, BITS), bool)
        for k in range(HASHES):
            self.filters[chain, (features >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True

    def __str__(self) -> str:
        return f"{self.n}:{base64.b64encode(np.packbits(self.filters).tobytes()).decode()}"


def _features(data: bytes, bits_of: np.ndarray) -> np.ndarray:
    """Different features: of short data the fine windows, then the wide ones; of data without a window, all of it."""
    n = len(data)
    if n <= FINE_WIDTH:
        return np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), np.uint64) if n else np.zeros(0, np.uint64)
    parts = [_windows(data, bits_of, FINE_WIDTH, FINE_REACH)] if n < SHORT else []
    if n > WIDTH:
        parts.append(_windows(data, bits_of, WIDTH, REACH))
    return np.concatenate(parts)


def _windows(data: bytes, bits_of: np.ndarray, width: int, wide: int) -> np.ndarray:
    """Different hashes in order of place of the windows of width bytes that are the rarest up to wide bytes around."""
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    total = np.concatenate([[0], np.cumsum(bits_of[raw[:-1].astype(np.int32) << 8 | raw[1:]], dtype=np.int32)])
    rarity = total[width - 1 :] - total[: n - width + 1]  # of the bytes in a window after its first
    best, reach = np.concatenate([np.full(wide, -1, np.int32), rarity, np.full(wide, -1, np.int32)]), 1
    while reach < wide:
        best = np.maximum(best[:-reach], best[reach:])
        reach *= 2
    # best[i] is the largest of wide rarities from i - wide on.
    m = len(rarity)
    at = np.flatnonzero((rarity > best[:m]) & (rarity >= best[wide : wide + m]) & (rarity >= best[wide + 1 : wide + 1 + m]))
    if not len(at):
        at = np.array([int(np.argmax(rarity))])
    words = np.lib.stride_tricks.sliding_window_view(raw, width)[at].copy().view(np.uint64)
    words ^= words >> np.uint64(29)
    mixed = (words * MULTIPLIERS[: width // 8]).sum(axis=1, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    _, first = np.unique(mixed, return_index=True)
    return mixed[np.sort(first)]


def likeness(a: Digest, b: Digest) -> float:
    """The mean, over the filters of the shorter chain, of the best normalised overlap with a filter of the other.

    The overlap of two filters is their common bits beyond what chance gives, as a share of the most that they could
    have. Two empty digests: 1; an empty one and another: 0.
    """
    if not a.n or not b.n:
        return float(a.n == b.n)
    if len(a.filters) > len(b.filters):
        a, b = b, a
    x, y = a.filters.astype(np.float32), b.filters.astype(np.float32)
    na, nb = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    chance = na * nb / BITS
    overlap = np.clip((x @ y.T - chance) / np.maximum(np.minimum(na, nb) - chance, 1e-6), 0, 1)
    # A nearly empty last filter says little: filters weigh by their bits.
    return float(round(float((overlap.max(axis=1) * na[:, 0]).sum() / na.sum()), 9))


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) characters replaced by the first as many of the following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _walker(bits_of_shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_of = bits_of_shared.value
        held: tuple[int | None, int, str, Digest] | None = None
        for batch in batches:
            rows = []
            for part, guest, doc_id, text in zip(*columns(batch, "part", "guest", "doc_id", "text"), strict=True):
                text = text or ""
                digest = Digest(text.encode(), bits_of)
                if held and held[1] == part:
                    old = held[2]
                    new = edited(old, text)
                    other = Digest(new.encode(), bits_of)
                    rows.append((held[0], len(old), hashlib.sha256(new.encode()).hexdigest(), str(held[3]), str(other), likeness(held[3], other), likeness(held[3], digest)))
                held = None if guest else (doc_id, part, text, digest)
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return run


def _bounds(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """At most n - 1 places (id, h) that cut rows into about n ranges; an id that fills several is cut by its hashes."""
    ids = Counter(map(int, rows.stat.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else Counter()
    return [(i, ((k << 64) // m) - (1 << 63)) for i, m in sorted(ids.items()) for k in range(m)]


def _part(bounds: list[tuple[int, int]]):
    """A column function: how many of bounds lie at or before (id, h)."""
    ids, cuts = (np.array([b[k] for b in bounds], np.int64) for k in (0, 1))

    @F.pandas_udf("int")
    def part(id: pd.Series, h: pd.Series) -> pd.Series:
        own, hashes = id.to_numpy(), h.to_numpy()
        out = np.searchsorted(ids, own, side="left")
        for i in np.intersect1d(ids, own):
            here = own == i
            out[here] += np.searchsorted(cuts[ids == i], hashes[here], side="right")
        return pd.Series(out.astype(np.int32))

    return part


def compare_next(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Documents stand in ascending order of doc_id, ties by a hash of the text, a null id first; after the last comes the
    first. Ranges of ids, and of hashes where many rows share an id, are dealt to tasks, which walk their documents in
    order; each range also gets the first document of the range after it as a guest. A digest takes the windows of WIDTH
    bytes that are rarer than all around them, by the surprise of their bytes over all texts, and sets HASHES bits for
    each in a chain of Bloom filters.

    Null and empty texts: empty digests; like each other 1, like others 0. Texts of under SHORT bytes also have windows of
    FINE_WIDTH bytes; those of up to FINE_WIDTH bytes are one feature.
    Repeated rows follow each other. A single document is its own next one. No rows: none. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LEAST)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    bounds = _bounds(rows, n)
    dealt = rows.withColumn("part", _part(bounds)("id", "h"))
    firsts = sorted((r["part"], r["f"]) for r in dealt.groupBy("part").agg(F.min(F.struct("id", "h")).alias("f")).collect())  # a row for each range
    after = [(p, *firsts[(i + 1) % len(firsts)][1]) for i, (p, _) in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(after, "part int, id long, h long"))
    smallest = rows.where(F.col("id").isin([f["id"] for _, f in firsts])).join(guests, ["id", "h"]).groupBy("id", "h", "part").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    guests = smallest.select(F.lit(None).cast("long").alias("doc_id"), "text", "id", "h", "part", F.lit(True).alias("guest"))
    every = dealt.withColumn("guest", F.lit(False)).unionByName(guests).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "guest", "id", "h", "text")
    result = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return every.select("part", "guest", "doc_id", "text").mapInArrow(_walker(spark.sparkContext.broadcast(surprise(docs))), result)
