"""Readers for the file layouts. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellclock.functions.clock import parse_slot, ts_from_parts
from cellclock.names import q

# The 25 columns of a strike record, in file order.
STRIKE_SCHEMA = (
    "version string, year int, month int, day int, hour int, minute int, second int, ms double, "
    "lat double, lon double, current double, stroke_count int, sensor_count int, dof double, "
    "ellipse_angle double, ellipse_major double, ellipse_minor double, chi_square double, "
    "rise_time double, peak_time double, max_rate double, stroke_type int, sensor_angle double, "
    "signal_flag string, time_flag string"
)

PIXEL_SCHEMA = "ts timestamp_ntz, row int, col int, value float, band string, date date"

# The ways a scene file spells its band and time.
FILE_PATTERNS = (
    r"([A-Za-z0-9]+)_(\d{4})(\d{2})(\d{2})(\d{2})0000\.tif$",
    r"([A-Za-z0-9]+)_(\d{4})(\d{2})(\d{2})\.Z(\d{2})(\d{2})\.(?:tif|zip|nc)$",
    r"([A-Za-z0-9]+)_(\d{4})(\d{2})(\d{2})_Z(\d{2})(\d{2})\.tif$",
    r"([A-Za-z0-9]+)_(\d{4})(\d{2})(\d{2})\.tif$",
    r"NC_([A-Z0-9]+)_(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})_[^/]*\.nc$",
)


def read_strikes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Headerless 25-column CSV, one or more yearly files."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(STRIKE_SCHEMA).csv(paths, header=False)


def read_csv_header(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep=sep)


def tsv_to_csv(spark: SparkSession, source: str, target: str, schema: str) -> None:
    read_csv_header(spark, source, schema, "\t").write.csv(target, header=True)


def read_samples(spark: SparkSession, path: str, columns: Sequence[str], ts: str = "rounded_dt_up") -> DataFrame:
    """The wanted columns that exist. When the timestamp column is wanted but not
    there, it is made from year, month, day, hour and minute."""
    df = spark.read.parquet(path)
    have = set(df.columns)
    parts = ["year", "month", "day", "hour", "minute"]
    if ts in columns and ts not in have and set(parts) <= have:
        df = df.withColumn(ts, ts_from_parts(*parts))
        have.add(ts)
    return df.select(*[q(c) for c in columns if c in have])


def read_many(spark: SparkSession, paths: Sequence[str], merge_schema: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(*paths)


def read_scales(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, ``{"BAND": {"min": …, "max": …}}``, possibly with
    ``original``/``scaled`` levels, to rows band, min, max, p2, p98, mean, median,
    max_abs. Both layouts may be mixed; a nested scale uses ``original``."""
    stats = "min double, max double, p2 double, p98 double, mean double, median double, max_abs double"
    shape = f"map<string, struct<{stats.replace(' double', ':double')}, original:struct<{stats.replace(' double', ':double')}>>>"
    lines = spark.read.text(path, wholetext=False).select(F.from_json("value", shape).alias("m"))
    rows = lines.select(F.explode("m").alias("band", "s"))
    names = ["min", "max", "p2", "p98", "mean", "median", "max_abs"]
    return rows.select("band", *[F.coalesce(F.col(f"s.original.{n}"), F.col(f"s.{n}")).alias(n) for n in names])


def read_strike_lookup(spark: SparkSession, path: str) -> DataFrame:
    """JSONL ``{"Y_M_D_h_m_row_col": value}`` to ts, row, col, amount."""
    lines = spark.read.text(path).select(F.from_json("value", "map<string,double>").alias("m"))
    rows = lines.select(F.explode("m").alias("key", "amount"))
    part = F.transform(F.split("key", "_"), lambda x: x.cast("int"))
    rows = rows.withColumn("p", part)
    return rows.select(
        ts_from_parts(*[F.col("p")[i] for i in range(5)]).alias("ts"),
        F.col("p")[5].alias("row"),
        F.col("p")[6].alias("col"),
        "amount",
    )


def read_time_list(spark: SparkSession, path: str) -> DataFrame:
    """Text time lists in any of the three notations: ts and, where given, band.
    Lines that hold no time are dropped."""
    lines = spark.read.text(path)
    band = F.regexp_extract("value", r"Band Missing:\s*(\S+)", 1)
    out = lines.select(parse_slot("value").alias("ts"), F.nullif(band, F.lit("")).alias("band"))
    return out.where(F.col("ts").isNotNull())


def parse_file_name(path) -> tuple:
    """(band, ts) columns from a path, trying each known spelling."""
    band = F.lit(None).cast("string")
    ts = F.lit(None).cast("timestamp_ntz")
    for pattern in FILE_PATTERNS:
        groups = pattern.count("(") - pattern.count("(?:")
        part = [F.regexp_extract(path, pattern, i) for i in range(1, groups + 1)]
        numbers = [p.try_cast("int") for p in part[1:]] + [F.lit(0)] * (5 - (groups - 1))
        hit = part[0] != ""
        ts = F.coalesce(ts, F.when(hit, F.try_make_timestamp_ntz(*numbers, F.lit(0))))
        band = F.coalesce(band, F.when(hit, part[0]))
    return band, ts


def file_index(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """path, length, modificationTime, band and ts of every file below ``path``; with
    ``folders`` the scene's name is that of the file's folder. The content column is not
    selected, so file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    band, ts = parse_file_name(F.regexp_extract("path", r"([^/=]+)/[^/]*$", 1) if folders else F.col("path"))
    return files.select("path", "length", "modificationTime", band.alias("band"), ts.alias("ts"))


def read_pixels(spark: SparkSession, path: str, bands: Sequence[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """The long pixel table, pruned to partitions of the given bands and dates."""
    df = spark.read.schema(PIXEL_SCHEMA).parquet(path)
    if bands is not None:
        df = df.where(F.col("band").isin(*bands))
    if first is not None:
        df = df.where(F.col("date") >= F.to_date(F.lit(first)))
    if last is not None:
        df = df.where(F.col("date") <= F.to_date(F.lit(last)))
    return df
