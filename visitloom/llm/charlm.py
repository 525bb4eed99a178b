"""Interpolated Kneser-Ney models over characters, for several classes at once.

A character becomes a symbol of 16 bits: 0 for whatever isn't a letter, the small form's code point for a letter (those
beyond 16 bits share the private range by hash), so four of them are a 64-bit number. Spark counts the highest order over
all documents and works out every probability; the orders below follow from distinct n-grams, as Kneser-Ney has it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import CHUNK, columns, cut, slices, stored

#: Characters of an n-gram, bits of each.
ORDER, BITS = 4, 16
#: A row of a model tells the log-probability of an n-gram of so many characters, or, by CONTEXT more, the log-weight
#: that a context of so many characters leaves to the order below; the empty one's is of a letter never seen.
CONTEXT = 10
MODEL = "kind int, key long, cls int, value float"


@cache
def alphabet() -> np.ndarray:
    """The symbol of each code point."""
    out = np.zeros(0x110000, np.uint16)
    for cp in range(0x110000):
        low = chr(cp).lower()[:1] if cp < 0xD800 or cp > 0xDFFF else " "
        if low.isalpha():
            out[cp] = ord(low) if ord(low) < 0xE000 else 0xE000 + (ord(low) * 2654435761 % (1 << 32) >> 7) % 0x1900
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, each text after ORDER - 1 blanks; where each text begins; its length."""
    pad = " " * (ORDER - 1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = alphabet()[np.frombuffer(pad.join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    keys = symbols.astype(np.uint64)
    n = len(keys)
    for k in range(1, ORDER):
        keys[k:] |= symbols[: n - k].astype(np.uint64) << np.uint64(BITS * k)
    return keys, starts, sizes


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    whole = [x or "" for x in texts]
    for a, b in slices([len(x) for x in whole], CHUNK):
        yield a, b, whole[a:b]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _counter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches with text and cls: the n-grams of each class with their counts, summed within the task."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for cls in list(held):
            keys, counts = _merged(held.pop(cls))
            for i in range(0, len(keys), 65536):
                part = keys[i : i + 65536].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([cls] * len(part), pa.int32()), pa.array(part), pa.array(counts[i : i + 65536])], ["cls", "gram", "n"])

    for batch in batches:
        texts, classes = columns(batch, "text", "cls")
        for a, b, some in pieces(texts):
            keys, starts, sizes = ngrams(some)
            of = np.array(classes[a:b])
            for cls in np.unique(of).tolist():
                own = np.concatenate([keys[s : s + n] for s, n in zip(starts[of == cls].tolist(), sizes[of == cls].tolist(), strict=True)])
                held.setdefault(cls, []).append(np.unique(own, return_counts=True))
        if sum(len(k) for x in held.values() for k, _ in x) > 4 * CHUNK:
            held = {cls: [_merged(x)] for cls, x in held.items()}
            if sum(len(x[0][0]) for x in held.values()) > 2 * CHUNK:
                yield from flushed()
    yield from flushed()


def counted(docs: DataFrame) -> DataFrame:
    """(cls, gram, n) over all rows of docs, which has text and the class as cls int."""
    parts = docs.select("text", "cls").mapInArrow(_counter, "cls int, gram long, n long")
    return parts.groupBy("cls", "gram").agg(F.sum("n").alias("n"))


def fitted(counts: DataFrame) -> DataFrame:
    """MODEL: the interpolated probabilities of every n-gram of counts (cls, gram, n), and the contexts' weights, by class.

    One discount for each class and order, from how many n-grams were seen once and twice. The lowest order leaves its
    share to the symbols of the class, and one more, evenly.
    """
    orders = [stored(counts)]
    for k in range(ORDER - 1, 0, -1):
        orders.append(stored(orders[-1].select("cls", F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1)).alias("gram")).groupBy("cls", "gram").agg(F.count("*").alias("n"))))
    orders.reverse()
    out, below = [], None
    for k, table in enumerate(orders, 1):
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        off = F.when(once == 0, 0.5).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.1), once / (once + 2 * twice))))
        offs = cut(table.groupBy("cls").agg(off.alias("off"), (F.lit(1.0) / (F.count("*") + 1)).alias("even")))
        ctx = F.shiftrightunsigned("gram", BITS)
        named = table.withColumn("ctx", ctx)
        tops = named.groupBy("cls", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("different")).join(F.broadcast(offs), "cls")
        tops = stored(tops.select("cls", "ctx", "total", "off", "even", (F.col("off") * F.col("different") / F.col("total")).alias("left")))
        rest: Column = F.col("even")
        rows = named.join(tops, ["cls", "ctx"])
        if below is not None:
            low = below.select("cls", F.col("gram").alias("low"), F.col("p").alias("low_p"))
            rows, rest = rows.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))).join(low, ["cls", "low"]), F.col("low_p")
        below = stored(rows.select("cls", "gram", ((F.col("n") - F.col("off")) / F.col("total") + F.col("left") * rest).alias("p")))
        out.append(below.select(F.lit(k).alias("kind"), F.col("gram").alias("key"), "cls", F.log("p").cast("float").alias("value")))
        weight = F.col("left") * F.col("even") if k == 1 else F.col("left")
        out.append(tops.select(F.lit(CONTEXT + k - 1).alias("kind"), F.col("ctx").alias("key"), "cls", F.log(weight).cast("float").alias("value")))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def asked(texts: list[str | None]) -> dict[int, np.ndarray]:
    """The keys of each kind that a model is looked up with for these texts."""
    grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *(ngrams(some)[0] for _, _, some in pieces(texts))]))
    out = {k: np.unique(grams & mask(k)) for k in range(1, ORDER + 1)}
    return out | {CONTEXT + k - 1: np.unique(out[k] >> np.uint64(BITS)) for k in range(1, ORDER + 1)}


def mask(k: int) -> np.uint64:
    return np.uint64((1 << (BITS * k)) - 1)


class Model:
    """Log-probabilities of each class, in sorted arrays for each order, from rows of MODEL (all, or those asked for)."""

    def __init__(self, rows: pa.Table, n_classes: int):
        kind, key, cls, value = (rows.column(c).to_numpy() for c in ("kind", "key", "cls", "value"))
        key = key.astype(np.int64).view(np.uint64)
        self.n_classes = n_classes
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in [*range(1, ORDER + 1), *range(CONTEXT, CONTEXT + ORDER)]:
            mine = kind == k
            keys, at = np.unique(key[mine], return_inverse=True)
            # A context that a class hasn't seen leaves all to the order below; an n-gram that it hasn't is filled in.
            table = np.full((len(keys), n_classes), np.nan if k < CONTEXT else 0.0, np.float32)
            table[at, cls[mine]] = value[mine]
            self.tables[k] = keys, table
        new = self.tables[CONTEXT][1]
        self.floor = new[0] if len(new) else np.zeros(n_classes, np.float32)
        for k in range(1, ORDER + 1):
            keys, table = self.tables[k]
            gap = np.isnan(table).any(axis=1)
            if gap.any():
                table[gap] = np.where(np.isnan(table[gap]), self._below(k, keys[gap]), table[gap])

    def _find(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, table = self.tables[kind]
        if not len(own):
            return np.zeros((len(keys), self.n_classes), np.float32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return table[at], own[at] == keys

    def _below(self, k: int, keys: np.ndarray) -> np.ndarray:
        """What an n-gram of k characters has that wasn't seen."""
        if k == 1:
            return np.broadcast_to(self.floor, (len(keys), self.n_classes))
        weight, seen = self._find(CONTEXT + k - 1, keys >> np.uint64(BITS))
        weight[~seen] = 0.0
        return weight + self._order(k - 1, keys & mask(k - 1))

    def _order(self, k: int, keys: np.ndarray) -> np.ndarray:
        out, seen = self._find(k, keys)
        new = np.flatnonzero(~seen)
        if len(new):
            out[new] = self._below(k, keys[new])
        return out

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """A row of log-probabilities, one for each class, for each n-gram."""
        return self._order(ORDER, keys)
