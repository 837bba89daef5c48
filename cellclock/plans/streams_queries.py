"""Streaming queries, drained to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellclock.functions.cleaning import normalize_missing
from cellclock.plans import fixtures as fx
from cellclock.plans.registry import query
from cellclock.session import scratch_path
from cellclock.streaming import incremental


@query("incremental_clean",
       oracle="SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events WHERE event_type <> 'view'")
def incremental_clean(spark, sf_dir):
    """Two arrivals of raw files; the second run must only take the new ones."""
    source, target, state = (scratch_path(spark, n) for n in ("raw", "clean", "state"))
    e = fx.table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 17 == 0, F.lit(-9999.0)).otherwise(F.col("value"))
    raw = e.select("event_id", "event_type", value.alias("value"))

    def clean(df):
        return normalize_missing(df, ["value"]).where("event_type <> 'view'").select("event_id", "value")

    for half in (0, 1):
        raw.where(F.col("event_id") % 2 == half).write.mode("append").parquet(source)
        incremental.incremental_clean(spark, source, raw.schema, clean, target, state).awaitTermination()
    return spark.read.parquet(target)


# Scenes of hour 5 of the first half come in a last file, long after the watermark has
# passed them: they are reported as gaps and then found to be late. Slots within two hours
# of the newest scene are not decided yet.
@query("scene_gap_monitor", views="px10",
       oracle="""WITH edge AS (SELECT date_trunc('day', min(ts)) AS a, max(ts) AS b, date_trunc('day', min(ts)) + (date_trunc('day', max(ts)) - date_trunc('day', min(ts))) / 2 AS mid FROM px10),
         slots AS (SELECT unnest(generate_series(a, b - INTERVAL 130 MINUTE, INTERVAL 10 MINUTE)) AS ts FROM edge), k AS (SELECT DISTINCT band FROM px10), p AS (SELECT DISTINCT ts, band FROM px10)
         SELECT s.ts AS ts, k.band AS band, p.ts IS NOT NULL AS late FROM slots s CROSS JOIN k CROSS JOIN edge LEFT JOIN p ON p.ts = s.ts AND p.band = k.band
         WHERE p.ts IS NULL OR (s.ts < date_trunc('day', edge.mid) AND hour(s.ts) = 5)""")
def scene_gap_monitor(spark, sf_dir):
    """Three drops of index files: the first half, the second, and late files of the first."""
    source, target, state = (scratch_path(spark, n) for n in ("index", "gaps", "state"))
    index = fx.px10(spark, sf_dir).select("ts", "band").distinct()
    a, b = index.agg(F.date_trunc("day", F.min("ts")), F.date_trunc("day", F.max("ts"))).first()
    middle = (a + (b - a) / 2).replace(hour=0, minute=0, second=0, microsecond=0)
    bands = sorted(r[0] for r in index.select("band").distinct().collect())  # one for each kind of event
    late = (F.col("ts") < F.lit(middle).cast("timestamp_ntz")) & (F.hour("ts") == 5)
    first = (F.col("ts") < F.lit(middle).cast("timestamp_ntz")) & ~late
    for part in (first, F.col("ts") >= F.lit(middle).cast("timestamp_ntz"), late):
        index.where(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(index.schema).parquet(source)
        incremental.scene_gap_monitor(stream, bands, a.replace(tzinfo=None), target, state).awaitTermination()
    return incremental.late_scenes(spark.read.parquet(target), index)


@query("scene_counts", oracle="""SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, event_type AS band, count(*) AS scenes FROM events GROUP BY ALL""")
def scene_counts(spark, sf_dir):
    """The same aggregate on a table: batch and stream share one definition."""
    e = fx.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("band"))
    return incremental.scene_counts(e)
