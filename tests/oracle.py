"""Compare a query's rows with those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connect(folder=FOLDER):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value + 0.0:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def differences(spark, name, query, sql, folder=FOLDER):
    df = query(spark, folder)
    rel = connect(folder).execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    off = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(off)} of {len(mine)} rows differ, as {str(off[0])[:600]}" if off else ""
