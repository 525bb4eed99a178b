"""Running sums, ranks and exact quantiles over all rows of a table, without one task that sees them all."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.operators.lineage import kept


def _summed(n: int):
    """Exclusive running sums of the last n columns within a sorted partition, and the partition's number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carried = TaskContext.get().partitionId(), [0] * n
        for batch in batches:
            rows, sums = batch.num_rows, []
            for k in range(n):
                own = batch.column(batch.num_columns - n + k).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(own) + carried[k]
                sums.append(pa.array(upto - own))
                carried[k] = int(upto[-1]) if rows else carried[k]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums, pa.array(np.full(rows, part, np.int32))], [*names, *(f"before_{x}" for x in names[len(names) - n :]), "part"])

    return run


def running(rows: DataFrame, by: list[str | Column], of: list[str]) -> DataFrame:
    """rows with before_<c> for each whole-number column of `of`: the sum of c over all rows before, in the order of by.

    Rows are sorted in ranges, each range sums up its own, and the sums of the ranges before are added; these are as many
    numbers as there are ranges, which is all that comes to the driver. by should tell rows apart: of equal ones any may
    come first. The other columns must be such as Arrow holds.
    """
    rest = [c for c in rows.columns if c not in of]
    sorted_rows = rows.select(*rest, *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in of]).repartitionByRange(*by).sortWithinPartitions(*by)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema)
    inside = kept(sorted_rows.mapInArrow(_summed(len(of)), f"{columns}, {', '.join(f'before_{c} long' for c in of)}, part int"))
    totals = inside.groupBy("part").agg(*[F.sum(c).alias(c) for c in of]).orderBy("part").collect()  # a row a range
    ahead, sums = [], [0] * len(of)
    for r in totals:
        ahead.append((r["part"], *sums))
        sums = [a + r[c] for a, c in zip(sums, of, strict=True)]
    offsets = rows.sparkSession.createDataFrame(ahead, "part int, " + ", ".join(f"ahead_{c} long" for c in of))
    out = inside.join(F.broadcast(offsets), "part")
    return out.select(*rest, *of, *[(F.col(f"before_{c}") + F.col(f"ahead_{c}")).alias(f"before_{c}") for c in of])


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a column, between two values in proportion; null without values.

    Values are counted, the counts summed up in order, and only the values at the ranks asked for come to the driver.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    upto = running(counted, ["v"], ["n"])
    whole = upto.agg(F.sum("n")).first()[0]
    if not whole:
        return [None] * len(shares)
    places = {s: s * (whole - 1) for s in shares}
    ranks = sorted({r for p in places.values() for r in (math.floor(p), math.ceil(p))})
    held = F.exists(F.array(*map(F.lit, ranks)), lambda r: (r >= F.col("before_n")) & (r < F.col("before_n") + F.col("n")))
    at = {}
    for r in upto.where(held).collect():  # two values a share at most
        at |= {k: r["v"] for k in ranks if r["before_n"] <= k < r["before_n"] + r["n"]}
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places.values()]
