"""Operators against brute force on small tables with hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellclock.grid import Grid
from cellclock.operators import histograms, lookups, metrics, nearest, ordered, profile, rasters, sampling, scoring
from cellclock.operators.lags import lag_features


def skewed(rng, n, hot=7.0):
    """A third of all values are one value."""
    x = np.round(rng.normal(0, 10, n), 2)
    x[: n // 3] = hot
    return x


def test_quantiles_with_a_hot_value(spark):
    x = skewed(np.random.default_rng(1), 900)
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(x)], "x double, g int").repartition(5)
    out = ordered.quantiles(df, "x", {"a": 0.02, "b": 0.5, "c": 0.98}, ["g"])
    for r in out.collect():
        want = np.quantile(x[r["g"] :: 2], [0.02, 0.5, 0.98])
        assert [r["a"], r["b"], r["c"]] == pytest.approx(want)


def test_running_total_and_numbers_cross_partitions(spark):
    df = spark.range(1000).select("id", F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k"), F.lit(2).alias("w")).repartition(6)
    total = {r["k"]: r["t"] for r in ordered.running_total(df, ["k"], {"t": "w"}).collect()}
    assert all(total[k] == 2 * (k + 1) for k in range(1000))
    g = df.withColumn("g", F.when(F.col("k") < 700, 0).otherwise(F.col("k") % 3 + 1))
    rows = ordered.number_rows(g, ["k"], "rn", ["g"]).collect()
    for group in range(4):
        ks = sorted((r["k"], r["rn"]) for r in rows if r["g"] == group)
        assert [rn for _, rn in ks] == list(range(1, len(ks) + 1))


def test_lag_features_across_chunk_borders(spark):
    slots = [s for s in range(300) if s % 11 != 5]
    df = spark.createDataFrame([(s, 0, 0, float(s)) for s in slots], "s int, row int, col int, B double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") * 600).cast("timestamp_ntz"))
    out = lag_features(df, ["B"], range(-6, 6), chunk=24)
    rows = {r["s"]: r for r in out.collect()}
    assert len(rows) == len(slots)
    for s in slots:
        for k in range(-6, 6):
            want = float(s + k) if s + k in rows else None
            assert rows[s][f"B_t{k:+d}"] == want


def brute_ring(flags, r, c, radius, ring):
    best = None
    for fr, fc in flags:
        dy, dx = fr - r, fc - c
        if max(abs(dy), abs(dx)) <= radius:
            key = ((max(abs(dy), abs(dx)),) if ring else ()) + (dy * dy + dx * dx, fr, fc)
            best = min(best, key) if best else key
    return best[-2:] if best else None


@pytest.mark.parametrize("metric", ["ring", "euclid"])
def test_nearest_cloud_cell_is_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    flags = {(int(t), int(r), int(c)) for t, r, c in zip(rng.integers(0, 4, 60), rng.integers(0, 60, 60), rng.integers(0, 60, 60))}
    flags = {f for f in flags if f[0] != 2} | {(0, 5, 5), (0, 6, 0)}
    strikes = [(i, int(rng.integers(0, 5)), int(rng.integers(-3, 64)), int(rng.integers(-3, 64))) for i in range(150)]
    strikes += [(150 + i, 0, 0, 0) for i in range(80)]  # a hot cell
    at = F.timestamp_seconds(F.col("t") * 600).cast("timestamp_ntz").alias("ts")
    mask = spark.createDataFrame(list(flags), "t int, row int, col int").select(at, "row", "col")
    df = spark.createDataFrame(strikes, "id int, t int, row int, col int").select("id", "t", at, "row", "col")
    # small tiles and a small radius exercise the borders
    out = nearest.nearest_cloud_cell(df, mask, max_radius=9, metric=metric, tile=16).collect()
    assert len(out) == len(strikes)
    for r in out:
        want = brute_ring([f[1:] for f in flags if f[0] == r["t"]], r["row"], r["col"], 9, metric == "ring")
        got = None if r["near_row"] is None else (r["near_row"], r["near_col"])
        assert got == want
        if want:
            d = 4 * np.hypot(want[0] - r["row"], want[1] - r["col"])
            assert r["distance_km"] == pytest.approx(d)


def test_ring_prefers_the_smaller_square(spark):
    mask = spark.createDataFrame([("2020-01-01 00:00:00", 5, 5), ("2020-01-01 00:00:00", 6, 0)], "ts string, row int, col int")
    df = spark.createDataFrame([("2020-01-01 00:00:00", 0, 0)], "ts string, row int, col int")
    mask, df = (x.withColumn("ts", F.col("ts").cast("timestamp_ntz")) for x in (mask, df))
    assert nearest.nearest_cloud_cell(df, mask).first()["near_col"] == 5
    assert nearest.nearest_cloud_cell(df, mask, metric="euclid").first()["near_row"] == 6


@pytest.mark.parametrize("radius", [None, 3.0])
def test_regrid_is_brute_force_with_a_hot_place(spark, radius):
    rng = np.random.default_rng(5)
    pts = [(i, 0.3, -0.3, float(i)) for i in range(100)]  # a third at one place
    pts += [(100 + i, float(rng.uniform(-2, 14)), float(rng.uniform(-14, 2)), float(i)) for i in range(20)]
    pts += [(120 + i, float(rng.normal(9, 0.4)), float(rng.normal(-9, 0.4)), float(i)) for i in range(180)]
    g = Grid(0.0, 0.0, 1.0, 1.0, 12, 12)
    df = spark.createDataFrame(pts, "id int, lon double, lat double, value double")
    got = {(r["row"], r["col"]): r["value"] for r in nearest.nearest_regrid(df, g, radius).collect()}
    assert len(got) == 144
    for (row, col), value in got.items():
        d2, _, v = min(((-lat - row - 0.5) ** 2 + (lon - col - 0.5) ** 2, i, v) for i, lon, lat, v in pts)
        assert value == (v if radius is None or d2 <= radius**2 else -9999.0)


def test_neighbours_are_brute_force_with_a_hot_cell(spark):
    rng = np.random.default_rng(6)
    pts = [(i, 3, 3) for i in range(40)] + [(40 + i, int(rng.integers(0, 30)), int(rng.integers(0, 30))) for i in range(80)]
    df = spark.createDataFrame(pts, "id int, row int, col int").withColumn("v", F.col("id").cast("double"))
    for r in nearest.nearest_neighbours(df, 4, ["v"]).collect():
        want = sorted(((p[1] - r["row"]) ** 2 + (p[2] - r["col"]) ** 2, p[0]) for p in pts if p[0] != r["id"])[:4]
        assert [(n["d2"], n["key"]) for n in r["neighbours"]] == want


def test_dilation_grows_clips_and_keeps(spark):
    mask = spark.createDataFrame([(1, 0, 0), (1, 9, 4)], "ts int, row int, col int")
    out = {(r["row"], r["col"]) for r in rasters.dilate_mask(mask, 10, 5, 2).collect()}
    want = {(r, c) for r in range(10) for c in range(5) for a, b in ((0, 0), (9, 4)) if max(abs(r - a), abs(c - b)) <= 2}
    assert out == want


@pytest.mark.parametrize("radius", [4, 5])
def test_dilation_of_cells_beyond_the_grid(spark, radius):
    cells = [(1, 12, 2), (1, 14, 2), (1, 40, 2), (1, 5, -3), (1, 2, 9)]
    mask = spark.createDataFrame(cells, "ts int, row int, col int")
    near = lambda r, c: any(max(abs(r - a), abs(c - b)) <= radius for _, a, b in cells)
    out = {(r["row"], r["col"]) for r in rasters.dilate_mask(mask, 10, 5, radius).collect()}
    assert out == {(r, c) for r in range(10) for c in range(5) if near(r, c)}
    out = {(r["row"], r["col"]) for r in rasters.dilate_mask(mask, None, None, radius).collect()}
    assert out == {(r, c) for r in range(-10, 60) for c in range(-20, 30) if near(r, c)}


def test_area_mean_beyond_the_grid(spark):
    fine, coarse = Grid(101.0, 24.0, 0.04, 0.04, 6, 3), Grid(101.0, 24.0, 0.12, 0.12, 2, 1)
    rows = [("a", 1, r, c, float(r * 10 + c)) for r in range(12) for c in range(6)]
    cells = spark.createDataFrame(rows, "band string, ts int, row int, col int, value double")
    want = {(r, c): np.mean([v for _, _, a, b, v in rows if (a // 3, b // 3) == (r, c)]) for r in range(4) for c in range(2)}
    for clip, kept in ((False, want), (True, {k: v for k, v in want.items() if k in ((0, 0), (1, 0))})):
        out = rasters.area_mean_resample(cells, fine, coarse, clip=clip).collect()
        assert {(r["row"], r["col"]): r["value"] for r in out} == pytest.approx(kept)


@pytest.mark.parametrize("name", ["area_mean_resample", "dilate_mask", "dilate_mask_r5", "region_pools"])
def test_rasters_of_many_users(spark, tmp_path, name):
    """Users beyond the 438 rows of the grid, as in the larger tables."""
    pytest.importorskip("duckdb")
    from check_oracle import compare, connect
    from conftest import SF_DIR

    from cellclock.plans.registry import load

    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    events.withColumn("user_id", F.col("user_id") * 10 + 6480).coalesce(1).write.parquet(str(tmp_path / "made"))
    (part,) = (tmp_path / "made").glob("*.parquet")
    (tmp_path / "events.parquet").hardlink_to(part)
    queries, oracles = load()
    assert compare(queries[name](spark, str(tmp_path)), connect(str(tmp_path)), oracles[name]) is None


def test_land_and_sea_differ_at_zero(spark):
    df = spark.createDataFrame([(0.0,)], "v double")
    row = df.select(rasters.land_sea_flag(F.col("v")), rasters.land_sea_flag(F.col("v"), "land_above")).first()
    assert tuple(row) == (1, 0)


@pytest.mark.parametrize("scale,most,block", [(1.5, 7, 10), (0.4, 3, 4), (50.0, 5, 16)])
def test_ratio_merge_against_a_loop(spark, scale, most, block):
    pos = [(i, f"p{0 if i % 3 else i % 5}") for i in range(60)]
    neg = [(1000 + i, f"n{0 if i % 3 else i % 4}") for i in range(100)]
    schema = "key int, file string"
    out = sampling.ratio_merge(spark.createDataFrame(pos, schema), spark.createDataFrame(neg, schema), scale, most, block=block)
    got = {}
    for r in out.collect():
        got.setdefault(r["part"], []).append(r["key"])
    stream = [k for _, k in sorted((f, k) for k, f in neg)]
    part, want = 0, {}
    for name in sorted({f for _, f in pos}):
        keys = sorted(k for k, f in pos if f == name)
        for start in range(0, len(keys), most):
            chunk = keys[start : start + most]
            take = int(len(chunk) * scale)
            want[part] = chunk + stream[:take]
            stream = stream[take:]
            part += 1
    assert {p: sorted(k) for p, k in got.items()} == {p: sorted(k) for p, k in want.items()}


def test_sample_n_is_exact_and_strict(spark):
    df = spark.range(5000)
    a, b = (sampling.sample_n(df, 321, ["id"]).collect() for _ in range(2))
    assert len(a) == len({r["id"] for r in a}) == 321 and sorted(a) == sorted(b)
    with pytest.raises(Exception, match="not enough rows"):
        sampling.sample_n(df, 6000, ["id"]).count()
    assert sampling.sample_n(df, 6000, ["id"], strict=False).count() == 5000


def test_early_stop(spark):
    scores = [0.1, 0.3, 0.3, 0.2, 0.29, 0.9]
    df = spark.createDataFrame([("a", i + 1, s) for i, s in enumerate(scores)], "run string, epoch int, score double")
    row = ordered.early_stop_point(df, "run", patience=3).first()
    assert (row["best_epoch"], row["best_score"], row["stop_epoch"]) == (2, 0.3, 5)


def test_curves_by_hand(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.2, 1), (float("nan"), 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    # thresholds .9 .8 .4 .2 -> (recall, precision) (1/3,1) (2/3,2/3) (2/3,1/2) (1,3/5)
    ap = (1 / 3) * 1 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5)
    auc = (1 / 3) * 1 + (1 / 3) * (1 + 2 / 3) / 2 + (1 / 3) * (1 / 2 + 3 / 5) / 2
    assert metrics.average_precision(df, "s").first()[0] == pytest.approx(ap)
    assert metrics.pr_auc(df, "s").first()[0] == pytest.approx(auc)
    assert metrics.roc_auc(df, "s").first()[0] == pytest.approx((2 + 1.5 + 0) / 6)


def test_metrics_of_empty_and_one_sided_sets(spark):
    df = spark.createDataFrame([(0, float("nan"), 1), (1, 0.9, 0), (1, 0.8, 0)], "horizon int, s double, y int")
    out = metrics.prf_zero_division(metrics.confusion_by_horizon(df, "s", 0.5)).orderBy("horizon").collect()
    assert out[0]["f1_1"] == 0.0 and out[1]["precision_1"] == 0.0 and out[1]["recall_0"] == 0.0
    assert metrics.roc_auc(df, "s", group_by=["horizon"]).where("horizon = 1").first()["roc_auc"] is None


def test_kge_needs_two_positives(spark):
    df = spark.createDataFrame([(0, 5.0, 4.0), (0, 0.0, 1.0)], "horizon int, y double, yhat double")
    row = metrics.regression_metrics(df).first()
    assert row["mae"] == 1.0 and row["mae_nonzero"] is None and row["kge_nonzero"] is None


def test_histogram_keeps_every_row(spark):
    rng = np.random.default_rng(8)
    rows = [("B", int(rng.integers(0, 2)), float(v)) for v in skewed(rng, 600)]
    pooled = spark.createDataFrame(rows, "band string, label int, value double")
    ranges = spark.createDataFrame([("B", -1000.0, 1000.0)], "band string, lo double, hi double")
    master = histograms.master_histogram(pooled, ranges)
    assert master.agg(F.sum("count")).first()[0] == 600
    scales = spark.createDataFrame([("B", -1000.0, 1000.0)], "band string, min double, max double")
    assert histograms.rebin_histogram(master, scales).agg(F.sum("count")).first()[0] == 600


def test_kde_bounds_near_the_unbinned_curve(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, 500), rng.normal(60, 1, 3)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = histograms.kde_bounds(df, "x").first()
    lo, hi = np.percentile(x, [0.5, 99.5])
    at = np.linspace(lo, hi, 1024)
    h = x.std(ddof=1) * len(x) ** -0.2
    dens = np.exp(-((at[:, None] - x) ** 2) / (2 * h * h)).sum(axis=1)
    above = np.flatnonzero(dens > 0.015 * dens.max())
    for value, i, end in ((got["x_left"], above[0], 0), (got["x_right"], above[-1], 1023)):
        assert (value is None) == (i == end)
        if value is not None:
            assert value == pytest.approx(at[i], abs=2 * (hi - lo) / 1023)


def brute_mi(x, y, k=3):
    from math import lgamma

    def psi(n, e=1e-5):
        return (lgamma(n + e) - lgamma(n - e)) / (2 * e)

    x = np.asarray(x, float).reshape(len(y), -1)
    total = 0.0
    for i in range(len(y)):
        d = np.abs(x - x[i]).max(axis=1)
        same = np.sort(d[y == y[i]])
        want = min(k, len(same) - 1)
        r = same[want]
        if r > 0:
            total += psi(want) - psi((d < r).sum())
        else:
            total += psi((same == 0).sum()) - psi((d == 0).sum())
        total -= psi(len(same))
    return max(0.0, psi(len(y)) + total / len(y))


def test_mutual_information_with_ties_and_block_borders(spark):
    rng = np.random.default_rng(10)
    y = rng.integers(0, 2, 240)
    x = rng.normal(0, 1, 240) + y
    tied = np.round(x)
    tied[:80] = 1.0
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, tied, y))], "id int, a double, b double, y int")
    got = {r["feature"]: r["mi"] for r in scoring.mutual_information_features(df, ["a", "b"], "y", "id", block=16).collect()}
    assert got["a"] == pytest.approx(brute_mi(x, y), abs=1e-6)
    assert got["b"] == pytest.approx(brute_mi(tied, y), abs=1e-6)


def test_joint_mutual_information(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 150)
    x = rng.normal(0, 1, (150, 2)) + y[:, None]
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id int, `A_t-2` double, `A_t-1` double, y int")
    got = scoring.mutual_information_joint(df, ["A"], "y", "id", offsets=(-2, -1)).first()["MI_score"]
    assert got == pytest.approx(brute_mi(x, y), abs=1e-6)


@pytest.mark.parametrize("n", [900, 20_300])
def test_joint_mutual_information_of_all_rows(spark, n):
    rng = np.random.default_rng(n)
    y = np.minimum(rng.integers(0, 40, n), 3)
    y[:2], y[2], y[5:7] = 7, 8, 9
    x = np.round(rng.normal(0, 1, (n, 2)) + y[:, None] / 3, 2)
    x[10:40] = x[10]
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id int, `A_t-2` double, `A_t-1` double, y int")
    got = scoring.mutual_information_joint(df, ["A"], "y", "id", offsets=(-2, -1), **({} if n > 20_000 else {"tile": 16})).first()["MI_score"]
    keep = y != 8  # a class of one row
    assert got == pytest.approx(brute_mi(x[keep], y[keep]), abs=1e-5)  # the digamma of brute_mi loses digits at large counts


def test_describe_shape_and_box(spark):
    x = skewed(np.random.default_rng(12), 300)
    df = spark.createDataFrame([(float(v),) for v in x], "value double")
    d = profile.describe(df).first()
    assert d["count"] == 300 and d["std"] == pytest.approx(x.std(ddof=1)) and d["p75"] == pytest.approx(np.quantile(x, 0.75))
    n, z = len(x), (x - x.mean()) / x.std()
    g1, g2 = (z**3).mean(), (z**4).mean() - 3
    s = profile.shape_stats(df, "value").first()
    assert s["skewness"] == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2))
    assert s["kurtosis"] == pytest.approx(((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))
    q1, q3 = np.quantile(x, [0.25, 0.75])
    b = profile.box_stats(df, "value").first()
    assert b["outliers"] == ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()


def test_rank_sum_first_place_parity(spark):
    df = spark.createDataFrame([("A(10)", 0), ("B(10)", 1), ("A(20)", 2), ("B(20)", 5)], "feature string, position int")
    assert dict(profile.feature_rank_sum(df).collect()) == {"A": 2, "B": 5}
    assert dict(profile.feature_rank_sum(df, skip_first=False).collect()) == {"A": 2, "B": 6}


def test_slots_per_year(spark):
    slots = lookups.calendar(spark, "2020-01-01", "2025-01-01")
    assert dict(profile.slots_per_year(slots).collect()) == {2020: 52704, 2021: 52560, 2022: 52560, 2023: 52560, 2024: 52704}


def test_asof_clips_before_the_first_raster(spark):
    rasters_ = spark.createDataFrame([("2020-01-17", 0, 0, 1.0), ("2020-02-02", 0, 0, 2.0)], "date string, row int, col int, value double")
    rasters_ = rasters_.withColumn("date", F.to_date("date"))
    days = [("2020-01-01 10:00:00",), ("2020-01-17 00:00:00",), ("2020-02-01 23:59:00",), ("2020-02-02 00:00:00",), ("2021-01-01 00:00:00",)]
    df = spark.createDataFrame(days, "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("row"), F.lit(0).alias("col"))
    out = lookups.asof_backward_lookup(df, rasters_, "value", "ndvi").orderBy("ts").collect()
    assert [r["ndvi"] for r in out] == [1.0, 1.0, 1.0, 2.0, 2.0]


def test_correlation_with_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0)], "a double, b double, c double")
    got = {(r[0], r[1]): r[2] for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "c")] is None and got[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])


def test_null_groups_are_groups(spark):
    from cellclock.operators import ordered, profile, sampling

    rows = [(i, "a" if i % 2 else None, float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "k long, g string, value double")
    numbered = ordered.number_rows(df, ["k"], partition_by=["g"]).collect()
    assert sorted((str(r.g), r.rn) for r in numbered) == sorted((g, n) for g in ("a", "None") for n in (1, 2, 3, 4))
    assert {r.g: r["count"] for r in profile.describe(df, "value", ["g"]).collect()} == {"a": 4, None: 4}
    stats = profile.band_stats(df.withColumnRenamed("g", "band")).collect()
    assert {r.band: r["max"] for r in stats} == {"a": 7.0, None: 6.0}
    quotas = spark.createDataFrame([("a", 1), (None, 3)], "g string, quota int")
    assert sorted(str(r.g) for r in sampling.sample_by_quota(df, quotas, ["g"], ["k"]).collect()) == ["None"] * 3 + ["a"]
    folded = sampling.stratified_folds(df, ["k"], "g", 2).count()
    assert folded == 8


def test_null_labels_are_left_out(spark):
    from cellclock.operators import metrics, models

    df = spark.createDataFrame([(0.9, 1), (0.8, None), (0.7, 0), (0.2, None), (0.1, 0)], "p double, y int")
    swept = metrics.threshold_sweep(df, "p", [0.5]).first()
    assert (swept.tp, swept.fp, swept.fn, swept.tn) == (1, 1, 0, 1)
    assert metrics.roc_auc(df, "p").first().roc_auc == 1.0
    weights = [r.weight for r in models.with_class_weight(df, "y").orderBy("p").collect()]
    assert weights == [0.75, 0.0, 0.75, 0.0, 1.5]


def test_kde_keeps_small_and_constant_groups(spark):
    from cellclock.operators.histograms import kde_bounds

    rows = [("big", float(i % 23)) for i in range(200)] + [("small", float(i)) for i in range(5)] + [("flat", 3.0)] * 4 + [("one", 1.0)]
    got = {r.g: (r.x_left, r.x_right) for r in kde_bounds(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert set(got) == {"big", "small", "flat", "one"}
    assert got["flat"] == got["one"] == (None, None)


def test_archive_names_and_neighbours_of_nothing(spark):
    from cellclock.names import archive_name, canonical_name
    from cellclock.operators.nearest import nearest_neighbours

    assert canonical_name("tbb_13") == "IRB" and archive_name("B04B") == "albedo_04" and archive_name("X") == "X"
    none = spark.createDataFrame([], "id long, row int, col int, v double")
    assert nearest_neighbours(none, 2, ["v"]).schema["neighbours"].dataType.typeName() == "array"


def test_tile_pairs_are_spread_over_tasks(spark, monkeypatch):
    """Few bytes, much work: pairs of tiles must not be coalesced into one task."""
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(0, 1, 2)), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, ["id", "A_t-2", "A_t-1", "y"])
    files = []

    def cut(frame, real=scoring.cut):
        out = real(frame)
        if "_d" in out.columns or out.columns == ["_t", "_i", "_n"]:
            files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(scoring, "cut", cut)
    scoring.mutual_information_joint(df, ["A"], "y", "id", offsets=(-2, -1), tile=16)
    assert len(files) == 2 and min(files) >= 6
