"""Writers. All output is written by the executors, in as many files as there are
partitions; nothing is gathered."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellclock.names import q


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    return target.getFileSystem(conf).exists(target)


def write_if_absent(df: DataFrame, path: str, policy: str = "skip") -> str | None:
    """``skip`` leaves an existing target alone and returns None; ``suffix`` writes
    beside it under the name plus 8 hex digits. Returns the path written."""
    if policy not in ("skip", "suffix"):
        raise ValueError(f"unknown policy: {policy}")
    if _exists(df, path):
        if policy == "skip":
            return None
        stem, dot, ext = path.rpartition(".")
        tag = uuid.uuid4().hex[:8]
        path = f"{stem}_{tag}.{ext}" if dot and "/" not in ext else f"{path}_{tag}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_parts(df: DataFrame, path: str, month: Column, part: Column, mode: str = "errorifexists") -> None:
    """One folder per month and part. Rows are gathered by (month, part) to avoid
    small files; the rebalance lets adaptive execution split an oversized part."""
    tagged = df.withColumns({"month": month, "part": part})
    tagged.hint("rebalance", F.col("month"), F.col("part")).write.mode(mode).partitionBy("month", "part").parquet(path)


def write_pixels(df: DataFrame, path: str, ts: str = "ts", mode: str = "errorifexists") -> None:
    """The pixel table, by band and date, rows sorted by time and cell within a
    file. A busy day is split over several files by the rebalance."""
    dated = df.withColumn("date", F.to_date(ts))
    spread = dated.hint("rebalance", F.col("band"), F.col("date"))
    spread.sortWithinPartitions("band", "date", ts, "row", "col").write.mode(mode).partitionBy("band", "date").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv", line: Column | None = None, mode: str = "errorifexists") -> None:
    """``csv`` with header, ``json`` lines, or ``text`` with ``line`` as the format."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=True)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "text":
        if line is None:
            raise ValueError("text reports need a line expression")
        df.select(line.alias("value")).write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def write_xy(
    df: DataFrame, x_path: str, y_path: str, key: Sequence[str], features: Sequence[str], labels: Sequence[str]
) -> None:
    """Features and labels to two outputs that share ``key``."""
    df.select(*key, *[q(c) for c in features]).write.mode("errorifexists").parquet(x_path)
    df.select(*key, *[q(c) for c in labels]).write.mode("errorifexists").parquet(y_path)
