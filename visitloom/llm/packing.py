"""Best-fit packing of tokenised documents into sequences, in bulk over length classes."""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import columns, stored

ROOM, END = 1024, 2
#: A length class is ranked in hash ranges of about so many pieces.
RANGE = 1 << 16


def vocabulary() -> tuple[str, str, str]:
    """Of the public byte-level BPE: its tokenizers file, the same vocabulary as ranks, its pre-tokenisation pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary.

    The same vocabulary as ranks gives the same ids as the tokenizers file several times faster; only texts with a
    special token's name go through the file.
    """

    def __init__(self, files: tuple[str, str, str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(files[0])
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(files[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bytes", pat_str=files[2], mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(t in text for t in self.special):
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


@cache
def _encoder(files: tuple[str, str, str]) -> Encoder:
    return Encoder(files)


def _cutter(files: tuple[str, str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(files)
        end = np.array([END], np.uint32).tobytes()
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for doc_id, text in zip(*columns(batch, "doc_id", "text"), strict=True):
                ids = encoder.ids(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % ROOM or ROOM, n + 1, ROOM)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as ids with END, cut into pieces of at most ROOM ids."""
    return docs.select("doc_id", "text").mapInArrow(_cutter(files or vocabulary()), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweeps(counts: dict[int, int], room: int = ROOM) -> np.ndarray:
    """Where the pieces of each length go: rows of length, first rank, first sequence, offset, how many.

    One sweep for each length, longest first: its pieces and the open sequences stand sorted, and each piece goes to the
    successor of its length among the gaps, the smallest that holds it. Pieces of one length are told apart by rank
    alone, sequences of one gap by number, so a sweep matches runs of ranks to runs of sequences; what finds no gap opens
    sequences; gaps shrink before the next sweep. There are at most room lengths and gaps, whatever the input.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    out, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                insort(sizes, gap)
                gaps[gap] = []
            runs = gaps[gap]
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + n)
            else:
                runs.append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (k := bisect_left(sizes, length)) < len(sizes):
            gap = sizes[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(k)
            used = min(n, left)
            out.append((length, rank, first, room - gap, used))
            if used < n:
                add(gap, first + used, n - used)
            add(gap - length, first, used)
            rank, left = rank + used, left - used
        each = room // length
        full, odd = divmod(left, each)
        for take, n in ((each, full), (odd, 1 if odd else 0)):
            if n:
                for j in range(take):
                    out.append((length, rank, opened, j * length, n))
                    rank += n
                add(room - take * length, opened, n)
                opened += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _placer(plan: np.ndarray):
    key = plan[:, 0] << 48 | plan[:, 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most ROOM ids: a row per piece, with sequence_id and offset.

    A document is the ids of its whole text and END; null or empty text: END alone. Only documents of more than ROOM ids
    are cut, the first piece being the short one. Pieces are counted by length and ranked within a length by a hash of
    id and piece; `sweeps` finds where each run of ranks goes, and tasks look their pieces up there. Repeated rows are
    packed each; a null doc_id stays null. Ties by rank among equal rows don't matter. Other columns are ignored. No rows:
    no sequences.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, files))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ROOM rows
    ranges = max(16, max(counts.values(), default=0) // RANGE)
    ranged = cut.withColumn("range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(ranges)))
    each = ranged.groupBy("length", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = each.select("length", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    plan = spark.sparkContext.broadcast(sweeps(counts))
    inside = F.row_number().over(Window.partitionBy("length", "range").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = ranged.withColumn("inside", inside).join(ahead, ["length", "range"])
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("inside") + F.col("ahead")).cast("long").alias("rank"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _placer(plan.value)(batches)

    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
