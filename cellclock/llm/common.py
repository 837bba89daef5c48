"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellclock.session import prepare, scratch_path

# Rows and bytes handed to Python at a time. Texts can be long, so batches stay short.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20
BITMAP_BITS = 24
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_shipped: set[str] = set()
_scratch: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # where the tables of written() are


def _ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def ready(spark: SparkSession) -> SparkSession:
    """Apply the settings the text operators assume, and bring the package to the workers."""
    prepare(spark)
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which survives lost executors.

    The codec is fast; these tables are read once or twice and then forgotten. Shuffle
    files of the write go when it ends, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _scratch[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Give back the disk of tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        df.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(_scratch.pop(df))


def perhaps_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``keys``, and with all others.

    A bitmap of a fixed number of hashes, 2 MB, goes to the rows, so that a semi join
    after this one moves fewer of them. Null keys are left out.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS))
    words = keys.where(F.col(key).isNotNull()).select(place.alias("p"))
    words = words.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("b"))
    found = words.toArrow()
    bitmap = _bitmap(found.column("w").to_numpy(), found.column("b").to_numpy())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(bitmap, np.uint64)
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            held = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(held.astype(bool)))

    (mark,) = fresh(rows, "_place")
    return rows.where(F.col(key).isNotNull()).withColumn(mark, place).mapInArrow(run, rows.schema)


def _bitmap(words, bits) -> bytes:
    import numpy as np

    out = np.zeros(1 << BITMAP_BITS - 6, np.int64)
    out[words] = bits
    return out.tobytes()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as ''."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % modulus


class Recent:
    """A bounded table of what was seen lately, in two generations.

    When the younger one is full it becomes the older one, and entries that are asked for
    again move up, so frequent keys stay known however many others pass by."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self[key] = found
        return found

    def __setitem__(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


def string_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes objects; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]
