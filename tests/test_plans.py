"""What the physical plans must and must not contain."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from cellclock.operators import histograms, lookups
from cellclock.plans import fixtures as fx
from cellclock.plans.registry import load
from cellclock.session import scratch_path
from cellclock.sources import readers, writers

QUERIES, _ = load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["dataset_assembly", "hourly_lookup", "nearest_cloud_cell", "nearest_regrid", "nearest_neighbours", "ratio_merge", "mutual_information"],
)
def test_no_pairwise_joins(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_calendars_meet_in_the_range_join(spark):
    text = plan(QUERIES["asof_backward_lookup"](spark, SF_DIR))
    assert text.count("BroadcastNestedLoopJoin") <= 1 and "CartesianProduct" not in text





def test_master_histogram_scans_once(spark):
    path = scratch_path(spark, "once")
    fx.samples(spark, SF_DIR).write.parquet(path)
    ranges = spark.createDataFrame([("V", 0.0, 1000.0)], "band string, lo double, hi double")
    text = plan(histograms.master_histogram(histograms.pooled_windows(spark.read.parquet(path), ["V"]), ranges))
    assert text.count("FileScan parquet") == 1


def test_pixels_are_pruned(spark):
    path = scratch_path(spark, "pixels")
    writers.write_pixels(fx.px10(spark, SF_DIR).withColumn("value", F.col("value").cast("float")), path)
    text = plan(readers.read_pixels(spark, path, ["click"], "2024-01-05", "2024-01-06").select("value"))
    assert "PartitionFilters: [" in text and "band" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "ReadSchema: struct<value:float>" in text


def test_column_pruning_reaches_the_scan(spark):
    text = plan(QUERIES["floor_hour"](spark, SF_DIR))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_hot_cell_is_split_by_adaptive_execution(spark):
    """A third of the strikes in one cell and slot: the lookup join must split it."""
    n = 30_000
    old = {}
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for key, value in small.items():
        old[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        ids = spark.range(0, n, 1, 8)
        row = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).cast("int")
        at = F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz")
        strikes = ids.select("id", F.sha2(F.col("id").cast("string"), 256).alias("payload"), at.alias("ts"), row.alias("row"), F.lit(0).alias("col"))
        table = spark.range(997).select(
            F.timestamp_seconds(F.lit(-600)).cast("timestamp_ntz").alias("ts"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.lit(1.0).alias("B")
        )
        out = lookups.attach_offsets(strikes, table, ["B"], [-1])
        rows = out.collect()
        assert len(rows) == n and all(r["B_t-1"] == 1.0 for r in rows)
        assert "skew=true" in plan(out)
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_bounds_of_bands_are_sent_to_the_rows(spark):
    """A shuffle by band would put all values of one into a task."""
    p = plan(QUERIES["range_violations"](spark, SF_DIR))
    assert "BroadcastHashJoin [band" in p and "SortMergeJoin [_lookup_key" not in p
