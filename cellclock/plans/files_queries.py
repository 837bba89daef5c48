"""Round trips through the file layouts, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellclock.functions.clock import format_slot
from cellclock.names import lag_name, q
from cellclock.operators.filters import small_file_filter
from cellclock.plans import fixtures as fx
from cellclock.plans.registry import query
from cellclock.session import scratch_path
from cellclock.sources import readers, writers


def _strike_file(spark, sf_dir):
    """Events in the layout of a strike record; columns without a counterpart empty."""
    e = fx.strikes(spark, sf_dir)
    known = {
        "version": F.lit("v1"), "year": F.year("ts"), "month": F.month("ts"), "day": F.dayofmonth("ts"),
        "hour": F.hour("ts"), "minute": F.minute("ts"), "second": F.second("ts").cast("int"), "ms": F.lit(0.0),
        "lat": F.col("lat"), "lon": F.col("lon"), "current": F.col("current"), "stroke_count": F.col("k"),
        "stroke_type": F.when(F.col("kind") == "error", 0).otherwise(1), "signal_flag": F.col("kind"),
        "time_flag": F.col("event_id").cast("string"),
    }
    fields = [f.strip().split(" ") for f in readers.STRIKE_SCHEMA.split(",")]
    return e.select(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


@query("read_strikes", views="strikes",
       oracle="""SELECT 'v1' AS version, CAST(year(ts) AS INT) AS year, CAST(day(ts) AS INT) AS day, CAST(minute(ts) AS INT) AS minute, lat, lon, current,
         CAST(kind <> 'error' AS INT) AS stroke_type, CAST(NULL AS DOUBLE) AS dof, CAST(event_id AS VARCHAR) AS time_flag FROM strikes""")
def read_strikes(spark, sf_dir):
    rows = _strike_file(spark, sf_dir)
    paths = []
    for half in (0, 1):  # two files, as with yearly ones
        path = scratch_path(spark, "strikes")
        rows.where(F.pmod("stroke_count", F.lit(2)) == half).write.csv(path, header=False)
        paths.append(path)
    out = readers.read_strikes(spark, paths)
    return out.select("version", "year", "day", "minute", "lat", "lon", "current", "stroke_type", "dof", "time_flag")


@query("read_csv_header", oracle="SELECT event_id, event_type, value FROM events")
def read_csv_header(spark, sf_dir):
    path = scratch_path(spark, "csv")
    writers.write_report(fx.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path, "csv")
    return readers.read_csv_header(spark, path, "event_id bigint, event_type string, value double")


@query("tsv_to_csv", oracle="SELECT p_partkey, p_name, p_retailprice FROM part")
def tsv_to_csv(spark, sf_dir):
    tsv, csv = scratch_path(spark, "tsv"), scratch_path(spark, "csv")
    schema = "p_partkey bigint, p_name string, p_retailprice double"
    fx.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").write.csv(tsv, header=True, sep="\t")
    readers.tsv_to_csv(spark, tsv, csv, schema)
    return readers.read_csv_header(spark, csv, schema)


@query("read_samples", views="strikes",
       oracle="SELECT event_id, date_trunc('minute', ts) AS rounded_dt_up, current FROM strikes")
def read_samples(spark, sf_dir):
    path = scratch_path(spark, "samples")
    parts = [f("ts").alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute))]
    writers.write_parquet(fx.strikes(spark, sf_dir).select("event_id", "current", "kind", *parts), path)
    return readers.read_samples(spark, path, ["event_id", "rounded_dt_up", "current", "not_there"])


@query("read_many", oracle="SELECT event_id, CASE WHEN event_id % 2 = 1 THEN value END AS value FROM events")
def read_many(spark, sf_dir):
    a, b = scratch_path(spark, "part"), scratch_path(spark, "part")
    e = fx.table(spark, sf_dir, "events")
    e.where("event_id % 2 = 0").select("event_id").write.parquet(a)
    e.where("event_id % 2 = 1").select("event_id", "value").write.parquet(b)
    return readers.read_many(spark, [a, b], merge_schema=True)


@query("read_scales", views="strikes",
       oracle="""SELECT kind AS band, min(current) AS min, max(current) AS max, CASE WHEN kind IN ('click', 'error') THEN CAST(min(k) AS DOUBLE) END AS p2 FROM strikes GROUP BY kind""")
def read_scales(spark, sf_dir):
    path = scratch_path(spark, "scales")
    per = fx.strikes(spark, sf_dir).groupBy("kind").agg(
        F.min("current").alias("min"), F.max("current").alias("max"), F.min("k").cast("double").alias("p2")
    )
    nested = F.struct(F.struct("min", "max", "p2").alias("original"), F.struct(F.lit(0.0).alias("min")).alias("scaled"))
    line = F.when(F.col("kind").isin("click", "error"), F.to_json(F.create_map("kind", nested))).otherwise(
        F.to_json(F.create_map("kind", F.struct("min", "max")))
    )
    writers.write_report(per, path, "text", line)
    return readers.read_scales(spark, path).select("band", "min", "max", "p2")


@query("read_strike_lookup", views="px10",
       oracle="SELECT ts, \"row\", col, value AS amount FROM px10 WHERE band = 'error'")
def read_strike_lookup(spark, sf_dir):
    path = scratch_path(spark, "lookup")
    px = fx.px10(spark, sf_dir).where("band = 'error'")
    key = F.concat_ws("_", *[f("ts") for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute)], "row", "col")
    writers.write_report(px, path, "text", F.to_json(F.create_map(key, "value")))
    return readers.read_strike_lookup(spark, path)


@query("read_time_list", views="px10",
       oracle="""SELECT ts, NULL::VARCHAR AS band FROM px10 WHERE band = 'click' UNION ALL SELECT ts, NULL FROM px10 WHERE band = 'view'
         UNION ALL SELECT ts, band FROM px10 WHERE band = 'error'""")
def read_time_list(spark, sf_dir):
    path = scratch_path(spark, "times")
    slash = F.date_format("ts", "y/M/d/H/m")
    report = F.concat(format_slot("ts", "report"), F.lit("; Band Missing: "), F.col("band"))
    line = F.when(F.col("band") == "click", format_slot("ts", "dash")).when(F.col("band") == "view", slash)
    line = line.when(F.col("band") == "error", report).otherwise("no time on this line")
    writers.write_report(fx.px10(spark, sf_dir), path, "text", line)
    return readers.read_time_list(spark, path)


@query("file_index", views="px10", oracle="SELECT DISTINCT band, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts FROM px10")
def file_index(spark, sf_dir):
    """Scene folders named like scene files; one file per band and day."""
    path = scratch_path(spark, "scenes")
    px = fx.px10(spark, sf_dir)
    name = F.concat(F.col("band"), F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit(".Z0000.tif"))
    days = px.select(name.alias("scene"), F.date_format("ts", "yyyyMMdd").alias("day")).distinct()
    days.repartition("scene").write.partitionBy("scene").text(path)
    return readers.file_index(spark, path, folders=True).select("band", "ts")


@query("small_file_filter",
       oracle="SELECT CAST(bit_count((event_id & -event_id) - 1) AS INT) AS file, true AS kept FROM events GROUP BY 1 HAVING count(*) * 2 >= 1000")
def small_file_filter_query(spark, sf_dir):
    """Files that halve in size, from the zeros at the end of the event's number, with
    two bytes per event."""
    path = scratch_path(spark, "sizes")
    e = fx.table(spark, sf_dir, "events").select(F.expr("bit_count((event_id & -event_id) - 1)").alias("file"), F.lit("x").alias("value"))
    e.repartition("file").write.partitionBy("file").text(path)
    kept = small_file_filter(readers.file_index(spark, path))
    return kept.select(F.regexp_extract("path", r"file=(\w+)/", 1).cast("int").alias("file"), F.lit(True).alias("kept"))


@query("pixels_table", views="px10",
       oracle="""SELECT band, ts, "row", col, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM px10 WHERE band IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'""")
def pixels_table(spark, sf_dir):
    path = scratch_path(spark, "pixels")
    px = fx.px10(spark, sf_dir).withColumn("value", F.col("value").cast("float"))
    writers.write_pixels(px, path)
    out = readers.read_pixels(spark, path, ["click", "view"], "2024-01-05", "2024-01-10")
    return out.select("band", "ts", "row", "col", F.col("value").cast("double").alias("value"))


@query("write_parquet", oracle="SELECT event_id, value FROM events")
def write_parquet(spark, sf_dir):
    path = scratch_path(spark, "plain")
    writers.write_parquet(fx.table(spark, sf_dir, "events").select("event_id", "value"), path, "uncompressed")
    return spark.read.parquet(path)


@query("write_if_absent", oracle="SELECT event_id, 1 AS copy FROM events UNION ALL SELECT event_id, 2 FROM events")
def write_if_absent(spark, sf_dir):
    """The first write wins, a second is skipped, a third goes beside it."""
    path = scratch_path(spark, "once")
    e = fx.table(spark, sf_dir, "events").select("event_id")
    first = writers.write_if_absent(e, path)
    skipped = writers.write_if_absent(e.limit(0), path)
    beside = writers.write_if_absent(e, path, "suffix")
    assert skipped is None and beside != first
    one, two = (spark.read.parquet(p).withColumn("copy", F.lit(i)) for i, p in ((1, first), (2, beside)))
    return one.unionByName(two)


@query("write_parts", oracle="SELECT event_id, CAST(month(ts) AS INT) AS month, CAST(event_id % 3 AS INT) AS part FROM events")
def write_parts(spark, sf_dir):
    path = scratch_path(spark, "parts")
    e = fx.table(spark, sf_dir, "events").select("event_id", "ts")
    writers.write_parts(e, path, F.month("ts"), F.pmod("event_id", F.lit(3)))
    return spark.read.parquet(path).select("event_id", "month", "part")


@query("write_report", oracle="SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def write_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    counts = fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    writers.write_report(counts, path, "json")
    return spark.read.schema("event_type string, n bigint").json(path)


@query("write_xy", views="samples", oracle='SELECT sid, "V_t-1", output_0 FROM samples')
def write_xy(spark, sf_dir):
    x, y = scratch_path(spark, "x"), scratch_path(spark, "y")
    s = fx.samples(spark, sf_dir)
    writers.write_xy(s, x, y, ["sid"], [lag_name("V", -1)], ["output_0"])
    return spark.read.parquet(x).join(spark.read.parquet(y), "sid").select("sid", q(lag_name("V", -1)), "output_0")
