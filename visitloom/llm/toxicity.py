"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm import charlm
from visitloom.llm.common import CHUNK, columns, is_held_out, slices, stored
from visitloom.llm.lookups import joined

#: A letter is predicted from at most ORDER - 1 characters before it in its word, and the models back off to LOW - 1.
ORDER, LOW = 8, 4
#: What is taken off a count of 1, of 2, and of 3 or more: in either class, and in both together.
OFF, OFF_BOTH = (0.95, 1.8, 2.5), (0.8, 1.2, 1.5)
#: Up to so many n-grams and contexts are sent to all tasks (12 bytes each); the log-ratios of more are joined.
SHARED = 1 << 23
#: What tells the key of a context from that of an n-gram of the same letters.
OF_CONTEXT = np.uint64(0xA0761D6478BD642F)
#: Letters of a window.
WINDOW = 6
#: At most so many labelled rows of each label, lowest hash of the id first, fit the calibration of three weights.
CALIBRATION_ROWS = 10_000
FEATURES = ("worst", "second", "mean_ratio")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def _places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts on end; where the n-gram of each letter begins and ends; how many letters each text has.

    An n-gram doesn't reach over the beginning of its word.
    """
    symbols = _letters()[np.frombuffer("\n".join(["", *texts]).encode("utf-32-le"), np.uint32)]
    letters = np.flatnonzero(symbols > 1)
    before = np.maximum.accumulate(np.where(symbols > 1, 0, np.arange(len(symbols))))[letters]
    last = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return symbols, np.maximum(before, letters - (ORDER - 1)), letters + 1, np.diff(np.concatenate([[0], np.searchsorted(letters, last, side="right")]))


def _hasher(symbols: np.ndarray):
    """A function from where runs of symbols begin and end to their 64-bit hashes."""
    n = len(symbols)
    powers, inverse = _powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * powers[:n], dtype=np.uint64)])

    def between(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        mixed = (total[end] - total[begin]) * inverse[begin]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        return mixed ^ (mixed >> np.uint64(29))

    return between


@cache
def _letters() -> np.ndarray:
    """The small form of each letter, 1 for any other code point."""
    out = np.ones(0x110000, np.uint64)
    for cp in range(0x110000):
        if not 0xD800 <= cp <= 0xDFFF and chr(cp).isalpha():
            out[cp] = ord(chr(cp).lower()[0])
    return out


_held: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64, and of its inverse."""
    if not _held or len(_held[0]) < n:
        size = max(n, CHUNK + 1024)
        base, back = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
        _held[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (base, back)]
    return _held[0][:n], _held[1][:n]

#: N-grams that a task holds before it sends their counts on.
HELD = 2 * CHUNK


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches with text and cls: n-grams and their counts in either class, summed within the task until there are
    more than HELD different ones, and then sent on.

    An n-gram is its letters, after a blank where its word begins.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        keys, words, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        kept, first, where = np.unique(keys, return_index=True, return_inverse=True)
        return kept, words[first], *(np.bincount(where, x, len(kept)).astype(np.int64) for x in counts)

    def flushed() -> Iterator[pa.RecordBatch]:
        _, words, *counts = merged(held)
        held.clear()
        for i in range(0, len(words), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 65536], pa.string()), *(pa.array(x[i : i + 65536]) for x in counts)], ["gram", "toxic", "ordinary"])

    for batch in batches:
        texts, classes = columns(batch, "text", "cls")
        for a, b, some in charlm.pieces(texts):
            symbols, begin, end, sizes = _places(some)
            keys, first, where = np.unique(_hasher(symbols)(begin, end), return_index=True, return_inverse=True)
            whole = np.where(symbols > 1, symbols, 32).astype(np.uint32).tobytes().decode("utf-32-le")
            words = np.empty(len(keys), object)
            words[:] = [whole[i:j] for i, j in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
            kind = np.repeat(np.array(classes[a:b], np.int64), sizes)
            held.append((keys, words, *(np.bincount(where[kind == k], minlength=len(keys)).astype(np.int64) for k in (1, 0))))
            if sum(len(x[0]) for x in held) > 2 * HELD:
                held[:] = [merged(held)]
                if len(held[0][0]) > HELD:
                    yield from flushed()
    if held:
        yield from flushed()


def counted(docs: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) over all rows of docs, which has text and the class as cls int."""
    parts = docs.select("text", "cls").mapInArrow(_count, "gram string, toxic long, ordinary long")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, of_context, ratio) of each n-gram of counts (gram, toxic, ordinary) and, where of_context, each context:
    the log-ratio of a letter's probabilities after its context in toxic and ordinary text.

    Either class keeps its discounted counts and leaves the rest to the counts of both together, and these leave theirs
    to the lower order: how many different n-grams end in it. A letter that didn't follow a context has only what the
    classes leave there, in which the rest is the same: a context's ratio is that of the two backoff weights. After an
    unseen context the classes are the same.
    """

    def off(n: Column, by: tuple[float, ...]) -> Column:
        return F.when(n == 0, 0.0).when(n == 1, by[0]).when(n == 2, by[1]).otherwise(by[2])

    def all_off(n: Column, by: tuple[float, ...]) -> Column:
        return F.count_if(n == 1) * by[0] + F.count_if(n == 2) * by[1] + F.count_if(n > 2) * by[2]

    ctx = F.expr("left(gram, length(gram) - 1)")
    counts = counts.select("gram", ctx.alias("ctx"), F.expr(f"right(gram, {LOW})").alias("low"), "toxic", "ordinary")
    toxic, ordinary, both = F.col("toxic"), F.col("ordinary"), F.col("toxic") + F.col("ordinary")
    lows = counts.groupBy("low").agg(F.count("*").alias("kinds")).withColumn("low_ctx", F.expr("left(low, length(low) - 1)"))
    tails = lows.groupBy("low_ctx").agg(F.sum("kinds").alias("all_kinds"), F.count("*").alias("different"))
    low_p = (F.col("kinds") - 0.5 + 0.5 * F.col("different") / 40) / F.col("all_kinds")
    lows = lows.join(tails, "low_ctx").select("low", low_p.alias("low_p"))
    sums = {"t": (toxic, OFF), "o": (ordinary, OFF), "b": (both, OFF_BOTH)}
    tops = stored(counts.groupBy("ctx").agg(*[F.sum(n).alias(f"{k}_all") for k, (n, _) in sums.items()], *[all_off(n, by).alias(f"{k}_off") for k, (n, by) in sums.items()]))

    def p(k: str, base: Column) -> Column:
        (n, by), total = sums[k], F.col(f"{k}_all")
        return F.when(total == 0, base).otherwise((n - off(n, by) + F.col(f"{k}_off") * base) / total)

    def left(k: str) -> Column:
        return F.when(F.col(f"{k}_all") == 0, 1.0).otherwise(F.col(f"{k}_off") / F.col(f"{k}_all"))

    whole = counts.join(lows, "low").join(tops, "ctx").withColumn("both_p", p("b", F.col("low_p")))
    ratio = F.log(F.greatest(p("t", F.col("both_p")), F.lit(1e-6)) / F.greatest(p("o", F.col("both_p")), F.lit(1e-6)))
    seen = whole.select("gram", F.lit(False).alias("of_context"), ratio.cast("float").alias("ratio"))
    return seen.unionByName(tops.select(F.col("ctx").alias("gram"), F.lit(True).alias("of_context"), F.log(left("t") / left("o")).cast("float").alias("ratio")))


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        symbols = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        symbols[symbols == 32] = 1
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        keys = _hasher(symbols)(np.concatenate([[0], end[:-1]]).astype(np.int64), end) if words else np.zeros(0, np.uint64)
        keys ^= np.where(np.array(batch.column(1).to_pylist(), bool), OF_CONTEXT, np.uint64(0))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(2)], ["key", "ratio"])


def keyed(ratios: DataFrame) -> DataFrame:
    """(key, ratio): the n-grams and contexts of log_ratios by the hashes that a text is looked up with."""
    return ratios.select("gram", "of_context", "ratio").mapInArrow(_keys, "key long, ratio float")


class Ratios:
    """Log-ratios by key: the keys in order, and where those with each beginning of some bits begin."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        if len(keys) and (keys[:-1] > keys[1:]).any():
            order = np.argsort(keys)
            keys, ratios = keys[order], ratios[order]
        self.keys, self.ratios, self.bits = keys, ratios, max(4, len(keys).bit_length())
        self.begins = np.empty((1 << self.bits) + 1, np.uint32)
        for i in range(0, 1 << self.bits, CHUNK):
            first = np.arange(i, min(i + CHUNK, 1 << self.bits), dtype=np.uint64) << np.uint64(64 - self.bits)
            self.begins[i : i + len(first)] = np.searchsorted(keys, first)
        self.begins[-1] = len(keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratio of each key, 0 where there is none; the places of those without."""
        home = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.begins[home].astype(np.int64), self.begins[home + 1].astype(np.int64)
        out = np.zeros(len(keys), np.float32)
        left, missing = np.arange(len(keys)), []
        while len(left):
            here = at[left] < end[left]
            missing.append(left[~here])
            left = left[here]
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = self.ratios[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
        return out, np.concatenate([np.zeros(0, np.int64), *missing])


def _worst(ratio: np.ndarray) -> tuple[float, float, float]:
    """The highest mean over a window, the highest over one that doesn't overlap it, the mean over all."""
    n = len(ratio)
    if not n:
        return 0.0, 0.0, 0.0
    total = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
    if n <= WINDOW:
        return total[-1] / WINDOW, 0.0, total[-1] / n
    means = (total[WINDOW:] - total[:-WINDOW]) / WINDOW
    k = int(np.argmax(means))
    rest = [means[: max(0, k - WINDOW + 1)], means[k + WINDOW :]]
    return float(means[k]), float(max((x.max() for x in rest if len(x)), default=0.0)), total[-1] / n


def _scored(batch: pa.RecordBatch, ratios: Ratios) -> list[pa.Array]:
    """All columns of the batch, whose last is text, and the features."""
    rows = []
    for _, _, some in charlm.pieces(batch.column(batch.num_columns - 1).to_pylist()):
        symbols, begin, end, sizes = _places(some)
        between = _hasher(symbols)
        values, unseen = ratios.find(between(begin, end))
        values[unseen] = ratios.find(between(begin[unseen], end[unseen] - 1) ^ OF_CONTEXT)[0]
        rows += [_worst(values[e - n : e]) for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
    features = np.array(rows, np.float64).reshape(-1, 3)
    return [*batch.columns, *(pa.array(features[:, k]) for k in range(3))]


def _with_shared(shared, kept: int):
    """The first kept columns of rows and the features, for about CHUNK characters at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = Ratios(*shared.value)
        for batch in batches:
            sizes = pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_pylist()
            for a, b in slices(sizes, CHUNK):
                columns = _scored(batch.slice(a, b - a), ratios)
                yield pa.RecordBatch.from_arrays([*columns[:kept], *columns[-3:]], [*batch.schema.names[:kept], *FEATURES])

    return run


def _asked(texts: list[str | None]) -> dict[int, np.ndarray]:
    """The keys that texts are looked up with."""
    keys = np.zeros(0, np.uint64)
    for _, _, some in charlm.pieces(texts):
        symbols, begin, end, _ = _places(some)
        between = _hasher(symbols)
        keys = np.unique(np.concatenate([keys, between(begin, end), between(begin, end - 1) ^ OF_CONTEXT]))
    return {0: keys}


def featured(rows: DataFrame, ratios: DataFrame, with_text: bool = False) -> DataFrame:
    """All columns of rows and the features, but the last one, their text, only with_text; ratios: (key, ratio), stored."""
    names = rows.columns if with_text else rows.columns[:-1]
    kinds = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names), *(f"{c} double" for c in FEATURES)])
    spark = rows.sparkSession
    if ratios.count() <= SHARED:
        known = ratios.toArrow()
        keys, values = known.column("key").to_numpy().view(np.uint64), known.column("ratio").to_numpy()
        del known
        order = np.argsort(keys)
        shared = spark.sparkContext.broadcast((keys[order], values[order]))  # in order, so no task sorts a copy
        return rows.mapInArrow(_with_shared(shared, len(names)), kinds)

    def score(found: pa.Table, batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Ratios(found.column("key").to_numpy().view(np.uint64), found.column("ratio").to_numpy())
        columns = _scored(batch, own)
        return pa.RecordBatch.from_arrays([*columns[: len(names)], *columns[-3:]], [*names, *FEATURES])

    return joined(rows, ratios.withColumn("kind", F.lit(0)), _asked, score, kinds)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the features and the intercept, by Newton's method with a small ridge; the rarer label weighs more."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.where(y == 1, ((y == 0).sum() / max(1, (y == 1).sum())) ** 0.5, 1.0)
    beta, ridge = np.zeros(x.shape[1]), 0.02 * len(y) * np.diag([1.0, 1.0, 1.0, 0.0]) / 100 + 1e-9 * np.eye(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def score(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted, worst, second, mean_ratio.

    labels: doc_id, toxic (0 or 1; null says nothing; of several rows for an id the highest holds). All letters of the
    labelled rows of folds 1 to 3 (crc32 of the id mod 5) are counted after what stands before them in their word, for
    toxic and ordinary texts; both models back off to the same counts. A text's features are length-normalised
    log-likelihood ratios: of its worst window of WINDOW letters, of its worst window elsewhere and of the whole. Three
    weights, fitted on labelled rows of fold 4 that the models haven't seen (at most CALIBRATION_ROWS of each label),
    make the score.

    Null and empty texts have the features 0, 0, 0 and get the score that follows. A null doc_id counts as held out.
    Repeated rows get a row each. Without toxic or without ordinary rows in either part, every score is 0. Other columns
    of docs and labels are ignored, but for those of carry, which the result has too (any but those named above).
    """
    rows = docs.select("doc_id", "text")
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("cls"))
    mine = rows.where(fold(F.col("doc_id")).isin(1, 2, 3) & F.col("text").isNotNull())
    counts = stored(counted(mine.join(marks, "doc_id").select("text", "cls")))
    known = all(counts.agg(F.sum("toxic"), F.sum("ordinary")).first())
    # Without texts of both classes nothing is evidence.
    ratios = stored(keyed(log_ratios(counts if known else counts.limit(0))))
    fits: list = []
    if known:
        ids = rows.where(fold(F.col("doc_id")) == 4).select("doc_id").join(marks, "doc_id")
        few = [ids.where(F.col("cls") == k).orderBy(F.xxhash64("doc_id")).limit(CALIBRATION_ROWS).distinct() for k in (0, 1)]
        chosen = rows.where(fold(F.col("doc_id")) == 4).join(few[0].unionByName(few[1]), "doc_id").select("doc_id", "cls", "text")
        seen = stored(featured(chosen, ratios))
        fits = [seen.where(F.col("cls") == k).orderBy(F.xxhash64("doc_id"), *FEATURES).limit(CALIBRATION_ROWS).select("cls", *FEATURES).toPandas() for k in (0, 1)]
    if fits and all(len(x) for x in fits):
        x = np.concatenate([f[list(FEATURES)].to_numpy(np.float64) for f in fits])
        beta = _logistic(x, np.concatenate([f["cls"].to_numpy() for f in fits]))
        z = sum((F.col(c) * float(b) for c, b in zip(FEATURES, beta, strict=False)), F.lit(float(beta[-1])))
        likely = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
    else:
        likely = F.lit(0.0)
    more = [c for c in carry if c not in ("doc_id", "text")]
    kept = docs.select("doc_id", *[F.col(c).alias(f"carry_{c}") for c in more], "text")  # a carried text goes once
    out = featured(kept, ratios, "text" in carry).withColumn("score", likely)
    return out.select("doc_id", *[F.col(c if c == "text" else f"carry_{c}").alias(c) for c in carry if c != "doc_id"], is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)
