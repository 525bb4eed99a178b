"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters (or bytes) that one numpy pass handles at a time inside a task.
CHUNK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a folder of our own only in local mode where none is set."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="visitloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


#: Lists that stored tables' folders are noted in, of this thread.
_noting: ContextVar[tuple[list[str], ...]] = ContextVar("noting", default=())


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Notes in paths the folders of the tables that are stored meanwhile."""
    before = _noting.set((*_noting.get(), paths))
    try:
        yield
    finally:
        _noting.reset(before)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: work done once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    for paths in _noting.get():
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table that a loop carries on. Files of many small parts are read by few tasks, and
    their size lets joins broadcast them, which parts of a checkpoint don't."""
    return stored(df)


def is_held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; without an id it is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def slices(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about limit; a larger one stands alone."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"
