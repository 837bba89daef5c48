"""The gap monitor: gaps appear when the watermark passes, once, and stay."""

import datetime as dt

from cellclock.session import scratch_path
from cellclock.streaming import incremental

START = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, band string"


def at(slot):
    return START + dt.timedelta(minutes=10 * slot)


def test_gaps_are_reported_once_and_late_scenes_take_nothing_back(spark):
    source, target, state = (scratch_path(spark, n) for n in ("index", "gaps", "state"))
    bands = ["A", "B", "never"]

    def drop(rows):
        spark.createDataFrame([(at(s) + dt.timedelta(minutes=m), b) for s, b, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        incremental.scene_gap_monitor(stream, bands, START, target, state, "1 hour").awaitTermination()
        return sorted((r.ts, r.band) for r in spark.read.schema(SCHEMA).parquet(target).collect())

    # the newest scene is slot 20, so the watermark stands at slot 14 and slots up to 13 are decided
    first = drop([(s, "A", 0) for s in range(21) if s not in (3, 4, 15)] + [(s, "B", 9) for s in range(0, 20, 2)])
    decided = lambda n, gone: sorted((at(s), b) for b, missing in gone.items() for s in range(n) if s in missing)
    gone = {"A": {3, 4}, "B": set(range(1, 30, 2)), "never": set(range(30))}
    assert first == decided(14, gone)
    # slots 3 and 4 of A come too late; slot 15, still open, comes in time
    second = drop([(3, "A", 0), (4, "A", 5), (15, "A", 0), (30, "A", 0)] + [(s, "A", 0) for s in range(21, 30)])
    gone["B"] |= {20, 22, 24, 26, 28}
    assert second == decided(24, gone)
    again = drop([(30, "B", 0)])
    assert again == second  # nothing new has passed
    gaps = spark.read.schema(SCHEMA).parquet(target)
    late = {(r.ts, r.band) for r in incremental.late_scenes(gaps, spark.read.schema(SCHEMA).parquet(source)).collect() if r.late}
    assert late == {(at(3), "A"), (at(4), "A")}
