"""Streams that stop and start again between arrivals."""

import random
from datetime import datetime, timedelta

from visitloom.streaming.state import OUTPUT, daily_counts, state_changes

DAY = datetime(2024, 1, 1)
SCHEMA = "patient_id long, status string, effective_at timestamp, expires_at timestamp"


def test_state_over_restarts(spark, tmp_path):
    """Five arrivals, out of order, each met by a query of its own that goes on from the checkpoint; the end is the batch's."""
    rng = random.Random(1)
    rows = [(p, rng.choice("abc"), DAY + timedelta(days=rng.randint(0, 9), hours=rng.randint(0, 23)), None) for p in range(6) for _ in range(8)]
    rows += [(7, "short", DAY, DAY + timedelta(days=2)), (8, "long", DAY, DAY + timedelta(days=400))]
    rows += [(9, "end", DAY + timedelta(days=60), None)]
    rng.shuffle(rows[:-3])
    rows, last = rows[:-1], rows[-1:]
    rng.shuffle(rows)
    arrivals = [rows[i::4] for i in range(4)] + [last]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in arrivals:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        changes = state_changes(spark.readStream.schema(SCHEMA).parquet(source), "30 days")
        changes.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema(OUTPUT).parquet(out).collect()
    changed = {}
    for r in told:
        if r["event"] == "changed":
            key = (r["effective_at"], r["status"])
            changed[r["patient_id"]] = max(changed.get(r["patient_id"], key), key)
    want = {}
    for p, status, at, _ in rows + last:
        want[p] = max(want.get(p, (at, status)), (at, status))
    assert changed == want
    assert [(r["patient_id"], r["status"]) for r in told if r["event"] == "expired"] == [(7, "unknown")]
    # No change is told twice, so what was known was kept over every restart.
    each = [(r["patient_id"], r["effective_at"], r["status"]) for r in told if r["event"] == "changed"]
    assert len(each) == len(set(each))


def test_days_over_restarts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(DAY + timedelta(days=rng.randint(0, 20)), rng.choice("xy")) for _ in range(200)]
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    held = {}
    for i in range(5):
        spark.createDataFrame(rows[i::5], "effective_at timestamp, kind string").coalesce(1).write.mode("append").parquet(source)
        days = daily_counts(spark.readStream.schema("effective_at timestamp, kind string").parquet(source))
        days.writeStream.outputMode("complete").foreachBatch(lambda df, _: held.update({(r["day"], r["kind"]): r["n"] for r in df.collect()})).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for at, kind in rows:
        want[at.date(), kind] = want.get((at.date(), kind), 0) + 1
    assert held == want
