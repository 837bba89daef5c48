"""The one-pass assembly against loops over Python dictionaries, and its plan."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cellclock.names import FULL, lag_name
from cellclock.operators import assembly
from cellclock.session import scratch_path

START = dt.datetime(2024, 1, 1)
SLOT = dt.timedelta(minutes=10)


@pytest.fixture(scope="module")
def world():
    rng = random.Random(12)
    pixels, hourly, dated = {}, {}, {}
    for n in range(300):
        for band in "ABC":
            for _ in range(3):
                pixels[band, START + n * SLOT, rng.randrange(4), rng.randrange(4)] = rng.random()
    for n in range(-2, 52):
        for r in range(2):
            if rng.random() < 0.9:
                hourly[START + dt.timedelta(hours=n), r, 0] = (rng.random(), rng.random())
    for day in (1, 2):
        for r in range(2):
            dated[dt.date(2024, 1, 1 + day), r, 0] = rng.random()
    static = {(r, c): float(r - c) for r in range(4) for c in range(3)}
    strikes = [(i, START + rng.randrange(-3, 303) * SLOT, rng.randrange(5), rng.randrange(4)) for i in range(400)]
    strikes += [(1000 + i, START + 40 * SLOT, 1, 1) for i in range(200)]  # a hot cell and slot
    strikes += [(2000, None, 1, 1), (2001, START, None, None)]
    return pixels, hourly, dated, static, [(*s, s[2] and s[2] // 2, 0) for s in strikes]


@pytest.fixture(scope="module")
def tables(spark, world):
    pixels, hourly, dated, static, strikes = world
    doubled = [(*k, v) for k, v in pixels.items()] + [(*k, v - 1) for k, v in list(pixels.items())[:50]]  # the largest counts
    return (
        spark.createDataFrame(strikes, "id long, ts timestamp_ntz, row int, col int, crow int, ccol int"),
        spark.createDataFrame(doubled, "band string, ts timestamp_ntz, row int, col int, value double"),
        spark.createDataFrame([(*k, *v) for k, v in hourly.items()], "ts timestamp_ntz, row int, col int, T double, P double"),
        spark.createDataFrame([(*k, v) for k, v in dated.items()], "date date, row int, col int, value double"),
        spark.createDataFrame([(*k, v) for k, v in static.items()], "row int, col int, value double"),
    )


def sources(tables):
    _, pixels, hourly, dated, static = tables
    coarse = ("crow", "ccol")
    return [
        assembly.scenes(pixels, ["A", "B"]),
        assembly.hours(hourly, ["T", "P"], cell=coarse),
        assembly.rasters(dated, "N", FULL, cell=coarse),
        assembly.static(static),
        assembly.labels(pixels, "C"),
    ]


def expected(world):
    pixels, hourly, dated, static, strikes = world
    first = min(d for d, _, _ in dated)
    out = {}
    for i, ts, r, c, cr, cc in strikes:
        row = {}
        for k in range(-6, 0):
            for b in "AB":
                row[lag_name(b, k)] = pixels.get((b, ts + k * SLOT, r, c)) if ts else None
        for k in FULL:
            at = ts and ts + k * SLOT
            hour = hourly.get((at.replace(minute=0), cr, cc), (None, None)) if ts else (None, None)
            row[lag_name("T", k)], row[lag_name("P", k)] = hour
            date = ts and max([d for d, _, _ in dated if d <= at.date()], default=first)
            row[lag_name("N", k)] = dated.get((date, cr, cc))
        row["Dem_value"] = static.get((r, c))
        for k in range(6):
            row[f"lightning_{k}"] = pixels.get(("C", ts + k * SLOT, r, c), 0.0) if ts else 0.0
        out[i] = row
    return out


def test_assembly_is_the_loop(world, tables):
    want = expected(world)
    want[2000]["Dem_value"] = None  # a strike without a time asks for nothing
    got = assembly.assemble(tables[0], sources(tables))
    assert got.columns == [*tables[0].columns, *[c for s in sources(tables) for c in s.columns]] and set(want[0]) < set(got.columns)
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == len(world[4]) == got.count()
    for i, row in want.items():
        have = {c: rows[i][c] for c in row}
        if i == 2000:
            have["Dem_value"] = None
        assert have == row, i


def test_nothing_asked_and_nothing_held(tables):
    none = assembly.assemble(tables[0].limit(0), sources(tables))
    assert none.collect() == [] and "A_t-6" in none.columns
    empty = [assembly.scenes(tables[1].limit(0), ["A"]), assembly.labels(tables[1].limit(0), "C")]
    got = assembly.assemble(tables[0], empty).collect()
    assert len(got) == 602 and all(r["A_t-1"] is None and r.lightning_0 == 0.0 for r in got)


def test_key_filter_loses_nothing(spark):
    keys = spark.range(5000).select(F.col("id").cast("int").alias("row"), (F.col("id") % 7).cast("int").alias("col"))
    for most in (1 << 26, 1 << 12):  # the second is far too small, which may only let more pass
        may_hold = assembly.key_filter(keys, ["row", "col"], 5000, most)
        assert keys.where(may_hold(["row", "col"])).count() == 5000
    others = keys.withColumn("row", F.col("row") + 1_000_000)
    may_hold = assembly.key_filter(keys, ["row", "col"], 5000)
    assert others.where(may_hold(["row", "col"])).count() < 250
    assert keys.where(assembly.key_filter(keys.limit(0), ["row", "col"], 0)(["row", "col"])).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_pruned_before_they_move(spark, tables):
    """The scan takes bands and times as filters, and between it and the join with the
    requests there is the Bloom filter but no aggregate."""
    path = scratch_path(spark, "pixels")
    tables[1].write.parquet(path)
    strikes = tables[0].where((F.col("ts") >= "2024-01-02") & (F.col("ts") < "2024-01-02 06:00"))
    out = assembly.assemble(strikes, [assembly.scenes(spark.read.parquet(path), ["A", "B"])])
    text = plan(out)
    assert "In(band, [A,B])" in text and "GreaterThanOrEqual(ts,2024-01-01T23:00)" in text and "LessThanOrEqual(ts," in text
    lines = text.splitlines()
    at = next(i for i, s in enumerate(lines) if "FileScan parquet" in s and "band#" in s)
    depth = lambda s: len(s) - len(s.lstrip(" :+-|*("))
    above, level = [], depth(lines[at])
    for s in reversed(lines[:at]):
        if depth(s) < level:
            above.append(s)
            level = depth(s)
        if "Join" in s and level == depth(s):
            break
    assert any("Filter" in s and "getbit" in s for s in above) and any("Join" in s for s in above)
    assert not any("Aggregate" in s for s in above)


def test_scenes_are_asked_for_by_blocks(tables):
    """Scenes and labels of one table are one source of at most three requests a strike."""
    merged, place = assembly._merged([assembly.scenes(tables[1], ["A"]), assembly.hours(tables[2], ["T"]), assembly.labels(tables[1], "C")])
    assert place == [0, 1, 0] and len(merged) == 2
    asked, _ = assembly.requests(tables[0].where("id < 400"), merged[:1])
    strikes = tables[0].where("id < 400 AND ts IS NOT NULL").select("ts", "row", "col").distinct().count()
    assert strikes < asked.count() <= 3 * strikes


def test_what_is_not_wanted_is_not_looked_up(world, tables):
    got = assembly.assemble(tables[0], sources(tables), columns=["lightning_0", "N_t+3"])
    assert got.columns == [*tables[0].columns, "N_t+3", "lightning_0"]
    want = expected(world)
    assert all(r["N_t+3"] == want[r.id]["N_t+3"] and r.lightning_0 == want[r.id]["lightning_0"] for r in got.collect())
    # The coarse cells are not even read.
    assert assembly.assemble(tables[0].drop("crow", "ccol"), sources(tables), columns=["lightning_0"]).count() == len(world[4])
