"""Streams of state observations: event time orders all, and state expires."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, effective_us long, expires_us long"
OUTPUT = "patient_id long, status string, effective_at timestamp, expires_at timestamp, event string"


def daily_counts(stream: DataFrame, late: str = "40 days") -> DataFrame:
    """Observations of each day and kind by event time, whatever their order of arrival; those later than late are lost.

    stream: effective_at (timestamp), kind. The result of a finished stream equals the batch result.
    """
    return stream.withWatermark("effective_at", late).groupBy(F.window("effective_at", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")


def _update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep a patient's newest observation, of several the one with the greatest status; say when it changes and expires."""
    if state.hasTimedOut:
        status, effective, expires = state.get
        state.remove()
        yield _row(key[0], "unknown", effective, expires, "expired")
        return
    best = state.get if state.exists else None
    old = best
    for frame in frames:
        for status, at, until in zip(frame["status"], frame["effective_at"], frame["expires_at"], strict=True):
            at_us = int(pd.Timestamp(at).value // 1000)
            until_us = None if pd.isna(until) else int(pd.Timestamp(until).value // 1000)
            if best is None or (at_us, status) > (best[1], best[0]):
                best = (status, at_us, until_us)
    if best is not None and best != old:
        state.update(best)
        if best[2] is not None and best[2] // 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(best[2] // 1000)
        yield _row(key[0], *best, "changed")


def _row(patient: int, status: str, effective: int, expires: int | None, event: str) -> pd.DataFrame:
    stamp = pd.to_datetime(pd.Series([effective], dtype="int64"), unit="us")
    until = pd.to_datetime(pd.Series([expires], dtype="Int64"), unit="us") if expires is not None else pd.Series([pd.NaT], dtype="datetime64[ns]")
    return pd.DataFrame({"patient_id": [patient], "status": [status], "effective_at": stamp, "expires_at": until, "event": [event]})


def state_changes(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Changes of each patient's state as observations arrive; an older one than what is known changes nothing.

    stream: patient_id, status, effective_at, expires_at. Event-time timers tell expiries once the watermark passes them.
    """
    return stream.withWatermark("effective_at", late).groupBy("patient_id").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
