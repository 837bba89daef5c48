"""Incremental cleaning and gap monitoring with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from cellclock.functions.clock import floor_clock


def incremental_clean(
    spark: SparkSession,
    source: str,
    schema,
    clean: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    available_now: bool = True,
):
    """Clean every new Parquet file of ``source`` once and append it to ``target``.

    The checkpoint remembers finished inputs, and the file sink commits a batch as
    a whole, so a restart neither repeats a file nor leaves half an output. A run
    with ``available_now`` ends when all present files are done.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = clean(reader.parquet(source)).writeStream.format("parquet").outputMode("append")
    query = query.option("path", target).option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True) if available_now else query.trigger(processingTime="1 minute")
    return query.start()


def scene_counts(index: DataFrame, watermark: str = "2 hours", step: int = 10, ts: str = "ts") -> DataFrame:
    """Scenes per slot and band from a stream (or table) of file-index rows; late
    rows beyond the watermark are no longer counted."""
    out = index.withColumn(ts, F.col(ts).cast("timestamp"))
    if index.isStreaming:
        out = out.withWatermark(ts, watermark)
    window = F.window(ts, f"{step} minutes")
    return out.groupBy(window, "band").agg(F.count(F.lit(1)).alias("scenes")).select(
        F.col("window.start").cast("timestamp_ntz").alias("ts"), "band", "scenes"
    )


def scene_gaps(counts: DataFrame, slots: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Slots of the clock for which a band has no scene."""
    wanted = slots.select("ts", F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"))
    return wanted.join(counts.select("ts", "band"), ["ts", "band"], "left_anti")


def gap_events(index: DataFrame, bands: Sequence[str], start: datetime, watermark: str = "2 hours", step: int = 10) -> DataFrame:
    """A stream of (ts, band): slots from ``start`` on for which a band had no scene when
    the watermark passed the end of the slot. Each gap is emitted once.

    Every scene is a tick of the clock for all bands, so a band without any scene is noticed
    too. A band's state is its next undecided slot and the slots seen beyond it, which the
    watermark bounds; an event-time timer ends the next slot even when no scene comes.
    Scenes of decided slots are late and change nothing here; see ``late_scenes``.
    """
    first, width = _minute(start), step
    ticks = (
        index.select(F.col("ts").cast("timestamp").alias("ts"), F.col("band").alias("_own"))
        .withWatermark("ts", watermark)
        .select("ts", "_own", F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"))
        .select("band", "ts", (F.col("_own") == F.col("band")).alias("own"))
    )

    def decide(key, frames, state):
        import pandas as pd

        at, seen = (first, []) if not state.exists else state.get
        seen = set(seen)
        for frame in frames:
            minutes = frame.loc[frame["own"].astype(bool), "ts"].astype("datetime64[us]").astype("int64") // 60_000_000
            seen.update(int(m) for m in (minutes - minutes % width).unique() if m >= at)
        passed = state.getCurrentWatermarkMs() // 60_000  # whole minutes
        missing = []
        while at + width <= passed:
            if at in seen:
                seen.discard(at)
            else:
                missing.append(at)
            at += width
        state.update((at, sorted(seen)))
        state.setTimeoutTimestamp(max((at + width) * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"ts": pd.to_datetime(pd.Series(missing, dtype="int64"), unit="m"), "band": [key[0]] * len(missing)})

    return ticks.groupBy("band").applyInPandasWithState(
        decide, "ts timestamp_ntz, band string", "next bigint, seen array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def _minute(at: datetime) -> int:
    return int((at - datetime(1970, 1, 1)).total_seconds()) // 60


def late_scenes(gaps: DataFrame, index: DataFrame, step: int = 10) -> DataFrame:
    """Reported gaps with ``late``: whether the scene did arrive, after the report."""
    there = index.select(floor_clock("ts", step).alias("ts"), "band", F.lit(True).alias("_late")).distinct()
    return gaps.join(there, ["ts", "band"], "left").select("ts", "band", F.coalesce("_late", F.lit(False)).alias("late"))


def scene_gap_monitor(
    index: DataFrame, bands: Sequence[str], start: datetime, target: str, checkpoint: str, watermark: str = "2 hours", step: int = 10
):
    """Append the gaps of the input that is there to ``target`` and end.

    The checkpoint keeps the state, so the next run goes on with the files that came
    meanwhile; what was reported stays, a late scene takes nothing back."""
    query = gap_events(index, bands, start, watermark, step).writeStream.format("parquet").outputMode("append")
    return query.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
