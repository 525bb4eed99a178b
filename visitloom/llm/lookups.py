"""Documents that meet a model too large to send to all tasks: packs of documents join the rows they ask for."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from visitloom.llm.common import CHUNK, columns, slices, stored

#: Documents come in packs of about so many characters.
PACK = 4 * CHUNK


def _packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, rows): rows with about PACK characters of text, their last column, as a compressed Arrow stream."""
    held: list[pa.RecordBatch] = []
    size = 0

    def closed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for x in held:
                out.write_batch(x)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pack", "rows"])

    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for a, b in slices([len(x or "") for x in texts], CHUNK):
            held.append(batch.slice(a, b - a))
            size += sum(len(x or "") for x in texts[a:b])
            if size >= PACK:
                yield closed()
                held, size = [], 0
    if held:
        yield closed()


def _wanted(asks: Callable[[list[str | None]], dict[int, np.ndarray]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pack, kind, key): each key once that the texts of a pack are looked up with."""
        for batch in batches:
            for pack, rows in zip(*columns(batch, "pack", "rows"), strict=True):
                keys: dict[int, np.ndarray] = {}
                for part in pa.ipc.open_stream(rows):
                    for kind, some in asks(part.column(part.num_columns - 1).to_pylist()).items():
                        keys[kind] = np.unique(np.concatenate([keys.get(kind, some[:0]), some]))
                for kind, every in keys.items():
                    for i in range(0, len(every), 65536):
                        some = every[i : i + 65536].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([pack] * len(some), pa.string()), pa.array([kind] * len(some), pa.int32()), pa.array(some)], ["pack", "kind", "key"])

    return run


def _with_found(score: Callable[[pa.Table, pa.RecordBatch], pa.RecordBatch]):
    def run(packs: pa.Table, found: pa.Table) -> pa.Table:
        return pa.Table.from_batches([score(found, part) for rows in packs.column("rows").to_pylist() for part in pa.ipc.open_stream(rows)])

    return run


def joined(rows: DataFrame, model: DataFrame, asks: Callable[[list[str | None]], dict[int, np.ndarray]], score: Callable[[pa.Table, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """score of the batches of rows, whose last column is text, each with the rows of model (kind, key, ...) it asks for.

    asks: of texts, the 64-bit keys of each kind that may be in the model. score: of what was found and a batch, a batch.
    """
    packs = stored(rows.mapInArrow(_packs, "pack string, rows binary"))
    found = packs.mapInArrow(_wanted(asks), "pack string, kind int, key long").join(model, ["kind", "key"]).select("pack", *model.columns)
    return packs.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(_with_found(score), schema)
