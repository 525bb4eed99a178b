"""Frequent phrases of texts, level by level: what is rare isn't extended, and words are fetched for what is left only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.operators.lineage import kept

WORD, OTHER = regex.compile(r"\p{L}{2,}"), regex.compile(r"\P{L}")
#: Bits that say which runs are frequent, sent to the tasks: 64 for each run, 16 MB at most. A bit may stand for several.
BITS = 1 << 27
#: Frequent runs that are sent to the tasks at a time to be named, 16 bytes each.
SENT = 1 << 22
#: Code points of text that a task works on at a time; different runs that it holds before it sends their counts on.
CHARS, HELD = 1 << 18, 1 << 19
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: What a code point's place in its word multiplies it by, once a place; odd, so it can be divided by.
PLACE = 0xD1342543DE82EF93
BIG = np.iinfo(np.int64).max
#: Lots that texts are dealt to by their ids.
LOTS = 1 << 8


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


@cache
def _letters() -> np.ndarray:
    """A number for each code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint64)
    at = np.array([ord(c) for c in regex.findall(r"\p{L}", "".join(map(chr, range(0x110000))))], np.uint64)
    out[at] = _mixed(at * PRIME)
    return out


@cache
def _places(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of PLACE, as many as bits number, and what undoes them."""
    return tuple(np.multiply.accumulate(np.array([1] + [x] * ((1 << bits) - 1), np.uint64)) for x in (PLACE, pow(PLACE, -1, 1 << 64)))


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """The text and where it begins, a long one in pieces that end before what is no letter."""
    at = 0
    while at < len(text):
        cut = OTHER.search(text, at + CHARS) if at + CHARS < len(text) else None
        end = cut.start() if cut else len(text)
        yield at, text[at:end]
        at = end


def _split(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of texts in small letters, and the number of its text."""
    hashes, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, piece in _pieces("\n".join(texts)):
        values = _letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        edges = np.flatnonzero(np.diff(values != 0, prepend=False, append=False))
        start, end = edges[::2], edges[1::2]
        long = end - start > 1
        start, end = start[long], end[long]
        up, down = _places(max(len(piece), CHARS).bit_length())
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(piece)])])
        hashes.append(_mixed((sums[end] - sums[start]) * down[start]))
        begins.append(start + at)
    ends = np.cumsum([len(x) + 1 for x in texts])
    return np.concatenate(hashes), np.searchsorted(ends, np.concatenate(begins), "right")


def _hashed(own: list[str], known: dict[str, int]) -> np.ndarray:
    """The hashes of words, those in known not worked out again."""
    new = list(dict.fromkeys(w for w in own if w not in known))
    known.update(zip(new, _split(new)[0].tolist(), strict=True))
    return np.array([known[w] for w in own], np.uint64)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Ids (BIG for none) and texts in small letters, about CHARS bytes at a time."""
    ids = batch.column(0).cast(pa.int64()).fill_null(BIG).to_numpy(zero_copy_only=False)
    upto = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(upto // CHARS, prepend=0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
        if a < b:
            yield ids[a:b], [(x or "").lower() for x in batch.column(1).slice(a, b - a).to_pylist()]


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    out = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        out = out * PRIME + h[k : k + len(out)]
    return out


def _inside(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _once(ways: tuple, keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Each key once; of its values in each column the sum or the like, or any, as ways say."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[at], *(x[order[at]] if way is None else way.reduceat(x[order], at) for way, x in zip(ways, columns, strict=True))]


def _gathered(parts: Iterable[list[np.ndarray]], ways: tuple) -> Iterator[list[np.ndarray]]:
    """Parts (keys and columns) put together, at most 2 * HELD keys and a part at a time, in lots of 65,536 keys."""
    held: list[list[np.ndarray]] = []

    def merged() -> list[np.ndarray]:
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        return _once(ways, *whole)

    def lots(whole: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        for i in range(0, len(whole[0]), 1 << 16):
            yield [x[i : i + (1 << 16)] for x in whole]

    for part in parts:
        held.append(_once(ways, *part))
        if sum(len(x[0]) for x in held) > 2 * HELD:
            held.append(merged())
            if len(held[0][0]) > HELD:
                yield from lots(held.pop())
    if held:
        yield from lots(merged())


def _runs(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each n words in a row: whether they are of one text, and their key; the keys of all runs a word shorter."""
    inner = _grams(h, max(1, n - 1))
    return of[: len(h) - n + 1] == of[n - 1 :], inner[:-1] * PRIME + h[n - 1 :] if n > 1 else inner, inner


def _shift(width: int) -> int:
    """Where a lot's number begins in the number of one of width bits."""
    return max(0, width.bit_length() - LOTS.bit_length())


def _lots(ids: np.ndarray) -> np.ndarray:
    return _mixed(ids.view(np.uint64)) & np.uint64(LOTS - 1)


def _counter(n: int, sent: Broadcast | None):
    """How often runs of n words stand whose two inner runs may be frequent, and the first lot of texts that has them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                for ids, texts in _slices(batch):
                    h, of = _split(texts)
                    if len(h) < n:
                        continue
                    fits, keys, inner = _runs(h, of, n)
                    if sent is not None:
                        known = _set(sent.value, inner)
                        fits &= known[:-1] & known[1:]
                    if fits.any():
                        yield [keys[fits], np.ones(np.count_nonzero(fits), np.int64), _lots(ids)[of[: len(fits)][fits]]]

        for keys, times, lot in _gathered(parts(), (np.add, np.minimum)):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times), pa.array(lot.view(np.int64))], ["key", "n", "lot"])

    return run


def _hits(batches: Iterable[pa.RecordBatch], sizes: Iterable[int], bits: np.ndarray, by_lot: bool) -> Iterator[tuple[int, np.ndarray, ...]]:
    """Runs that have a bit, by key or by key and lot: size, key, id of the text, place, and all words and inner runs there."""
    for batch in batches:
        for ids, texts in _slices(batch):
            h, of = _split(texts)
            lots = _lots(ids) << np.uint64(_shift(8 * len(bits))) if by_lot else np.zeros(len(ids), np.uint64)
            for n in sizes:
                if len(h) >= n:
                    fits, keys, inner = _runs(h, of, n)
                    at = np.flatnonzero(fits & _set(bits, keys ^ lots[of[: len(keys)]]))
                    if len(at):
                        yield n, keys[at], ids[of[at]], at, h, inner


def _teller(stops: np.ndarray, most: int, sent: Broadcast):
    """Of runs in their first lots: whether each is a phrase (not between stop words, nor of stop words alone), and the keys
    of the two runs in it that are a word shorter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[list[np.ndarray]]:
            for n, keys, _, at, h, inner in _hits(batches, range(1, most + 1), sent.value, True):
                stop = _inside(h, stops)
                good = ~(stop[at] & stop[at + n - 1]) & ~np.logical_and.reduce([stop[at + k] for k in range(n)])
                yield [keys, np.full(len(at), n, np.int32), good, inner[at], inner[at + (n > 1)]]

        for keys, size, good, left, right in _gathered(parts(), (None, None, None, None)):
            inner = [pa.array(x.view(np.int64), mask=size == 1) for x in (left, right)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(size), pa.array(good), *inner], ["key", "size", "good", "left", "right"])

    return run


def _placer(sizes: tuple[int, ...], sent: Broadcast):
    """The smallest id of a text with each run."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = ([keys, ids, np.full(len(keys), n, np.int32)] for n, keys, ids, *_ in _hits(batches, sizes, sent.value, False))
        for keys, first, size in _gathered(hits, (np.minimum, None)):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(size), pa.array(first, mask=first == BIG)], ["key", "size", "example"])

    return run


def _namer(sent):
    """The words of each key of sent (keys and examples by size) in the text that is its example, so about once in all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        wanted = {n: x for n, x in sent.value.items() if len(x[0])}
        asked = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for _, x in wanted.values())]))
        for batch in batches:
            rows: list[tuple[int, int, str]] = []
            ids = batch.column(0).cast(pa.int64()).fill_null(BIG).to_numpy()
            some = np.flatnonzero(_inside(ids, asked))
            for i, text in zip(ids[some].tolist(), batch.column(1).take(pa.array(some)).to_pylist(), strict=True):
                own = words(text)
                h = _hashed(own, known)
                for n, (keys, examples) in wanted.items():
                    grams = _grams(h, n)
                    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    hit = np.flatnonzero((keys[at] == grams) & (examples[at] == i))
                    _, first = np.unique(at[hit], return_index=True)
                    rows += [(n, int(k), " ".join(own[j : j + n])) for k, j in zip(grams[hit[first]].view(np.int64).tolist(), hit[first].tolist(), strict=True)]
            made = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int32(), pa.int64(), pa.string()), strict=True)], ["size", "key", "phrase"])

    return run


def _examples(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and the example of each, BIG for none."""
    rows = table.select("key", "example").toArrow()
    keys = rows.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("example").cast(pa.int64()).fill_null(BIG).to_numpy()[order]


def _bits(rows: DataFrame, by_lot: bool = False) -> Broadcast:
    """The bits of all keys, or of keys and lots, sent; the driver gets at most BITS however many keys there are."""
    width = min(BITS, 1 << max(15, (64 * rows.count()).bit_length()))
    key = F.col("key").bitwiseXOR(F.shiftleft("lot", _shift(width))) if by_lot else F.col("key")
    dealt = rows.select((key.bitwiseAND(width - 1) + 1).alias("at")).withColumn("bucket", F.bitmap_bucket_number("at")).repartition("bucket")
    out = np.zeros((max(1, width >> 15), 1 << 12), np.uint8)
    for bucket, bits in dealt.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():
        out[bucket - 1] = np.frombuffer(bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out.ravel()[: width >> 3])


def _dealt(texts: DataFrame) -> DataFrame:
    rows, least = texts.select("id", "text"), texts.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= least else rows.repartition(least)  # few files: a small table


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _levels(rows: DataFrame, stop: list[str], least: int, most: int) -> DataFrame:
    """Runs of up to most words that stand least times or more: size, key, n, good, and the keys of the two runs in each
    that are a word shorter, left and right.

    Only keys, counts and lots are shuffled for all runs; the rest is looked up where a frequent one stands in its lot.
    """
    counts, sent = [], None
    for n in range(1, most + 1):
        times = rows.mapInArrow(_counter(n, sent), "key long, n long, lot long").groupBy("key").agg(F.min("lot").alias("lot"), F.sum("n").alias("n"))  # a random byte beside the key packs best
        counts.append(kept(times.where(F.col("n") >= least).withColumn("size", F.lit(n))))
        if sent:
            sent.unpersist()
        sent = _bits(counts[-1]) if n < most else None
    every = _all(counts)
    lots = _bits(every, by_lot=True)
    stops = np.sort(_hashed([w for w in stop if WORD.fullmatch(w)], {}))
    told = rows.mapInArrow(_teller(stops, most, lots), "key long, size int, good boolean, left long, right long").groupBy("size", "key")
    whole = kept(every.drop("lot").join(told.agg(*[F.any_value(c).alias(c) for c in ("good", "left", "right")]), ["size", "key"]))
    lots.unpersist()
    return whole


def _named(rows: DataFrame, found: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """phrase, n, example of runs (size, key, n)."""
    found = kept(found)
    bits = _bits(found)
    first = rows.mapInArrow(_placer(sizes, bits), "key long, size int, example long").groupBy("size", "key").agg(F.min("example").alias("example"))
    found = kept(found.join(first, ["size", "key"]))
    bits.unpersist()
    parts, named = max(1, -(-found.count() // SENT)), None
    for p in range(parts):
        mine = found.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == p)
        wanted = rows.sparkSession.sparkContext.broadcast({n: _examples(mine.where(F.col("size") == n)) for n in sizes})
        one = rows.mapInArrow(_namer(wanted), "size int, key long, phrase string").dropDuplicates(["size", "key"])
        named = one if named is None else named.unionByName(one)
    return found.join(named, ["size", "key"]).select("phrase", "n", "example")


def frequent_phrases(texts: DataFrame, stop: list[str], least: int, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """phrase, n, example of runs of words in texts (id, text) that stand least times or more.

    Words are runs of two letters or more, small. Runs between two stop words or of stop words alone are no phrases;
    example is the smallest id of a text with it. A run can only be as frequent as the runs in it, so level n counts those
    runs whose two inner ones may be frequent; counts are by 64 bits of the words, summed within each task first.
    """
    rows = _dealt(texts)
    whole = _levels(rows, stop, least, max(sizes))
    return _named(rows, whole.where(F.col("good") & F.col("size").isin(*sizes)).select("size", "key", "n"), sizes)


def _forms(known: DataFrame, most: int) -> DataFrame:
    """size, key of the known forms (phrase) that are runs of up to most words; no other can be in a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(x or "").split(" ") for x in batch.column(0).to_pylist()]
            own = [x for x in split if len(x) <= most and all(WORD.fullmatch(w) for w in x)]
            keys = [int(_grams(_hashed(x, {}), len(x)).view(np.int64)[0]) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in own], pa.int32()), pa.array(keys, pa.int64())], ["size", "key"])

    return kept(known.select(F.lower("phrase").alias("phrase")).distinct().mapInArrow(run, "size int, key long"))


def mine_phrases(texts: DataFrame, stop: list[str], least: int, top: int, known: DataFrame, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """The top frequent phrases of texts not held by a kept longer one, nor holding a known form (phrase).

    What holds what is told by keys, a word longer or shorter at a time; only runs that stand as often as the last of the
    top are named.
    """
    rows, most = _dealt(texts), max(sizes)
    whole, forms = _levels(rows, stop, least, most), _forms(known, most)
    levels = {n: whole.where(F.col("size") == n) for n in range(1, most + 1)}

    def having(n: int, column: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
        return levels[n].join(keys.select(F.col("key").alias(column)), column, how)

    bad = {0: None}
    for n in levels:
        hit = [having(n, "key", forms.where(F.col("size") == n))] + ([having(n, side, bad[n - 1]) for side in ("left", "right")] if n > 1 else [])
        bad[n] = kept(_all([x.select("key") for x in hit]).distinct())
    held, left = None, []
    for n in reversed(levels):
        own = having(n, "key", bad[n], "left_anti").where("good") if n in sizes else None
        if own is not None:
            left.append((own if held is None else own.join(held, "key", "left_anti")).select("size", "key", "n"))
        longer = ([own.select("left", "right")] if own is not None else []) + ([having(n, "key", held).select("left", "right")] if held is not None else [])
        if n > 1 and longer:
            held = kept(_all(longer).select(F.explode(F.array("left", "right")).alias("key")).distinct())
    found = kept(_all(left))
    last = found.select("n").orderBy(F.col("n").desc()).limit(top).agg(F.min("n")).first()[0]
    return _named(rows, found.where(F.col("n") >= (last or 0)), sizes).orderBy(F.col("n").desc(), "phrase").limit(top)
