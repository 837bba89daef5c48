"""Feature scores and models on the fixture views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellclock.names import FULL, HISTORY, HORIZONS, lag_columns, q
from cellclock.operators import models, reshape, scoring
from cellclock.operators.newton import Fit, NewtonLogistic, fit_logistics
from cellclock.operators.ordered import best_step
from cellclock.plans import fixtures as fx
from cellclock.plans.profiles_queries import rounded
from cellclock.plans.registry import query
from cellclock.plans.reshaping_queries import _slice_sql as slice_sql, hash_sql

COLS = lag_columns(["A", "B"], HISTORY)

# ---- model-free scores ------------------------------------------------------


@query("point_biserial", views="features",
       oracle="WITH c AS (" + " UNION ALL ".join(f"""SELECT '{c[0]}' AS band, abs(corr("{c}", y)) AS corr FROM features""" for c in COLS)
       + ") SELECT band, round(avg(corr), 6) AS corr FROM c GROUP BY band")
def point_biserial(spark, sf_dir):
    return rounded(scoring.point_biserial(fx.features(spark, sf_dir), ["A", "B"], "y")).select("band", "corr")


@query("point_biserial_features", views="samples",
       oracle=" UNION ALL ".join(f"""SELECT '{c}' AS feature, round(abs(corr("{c}", output_0)), 6) AS corr FROM samples""" for c in lag_columns(["V", "K"], HISTORY)))
def point_biserial_features(spark, sf_dir):
    out = scoring.point_biserial_features(fx.samples(spark, sf_dir), lag_columns(["V", "K"], HISTORY), "output_0")
    return rounded(out).select("feature", "corr")


# With t = sqrt(n - 2) tan(a) the two tails of Student's density are the integral of
# cos(a)^(n - 3) from asin |r| to pi / 2, over that from 0; both by Simpson's rule.
_P_SQL = "c AS (" + " UNION ALL ".join(f"""SELECT '{c[0]}' AS band, '{c}' AS f, abs(corr("{c}", y)) AS r, count(*) AS n FROM features""" for c in COLS) + """),
  i AS (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(4001) t(i)),
  p AS (SELECT band, f, any_value(r) AS r, (pi() / 2 - asin(any_value(r))) * sum(w * cos(asin(r) + i * (pi() / 2 - asin(r)) / 4000) ** (n - 3)) / (pi() / 2 * sum(w * cos(i * pi() / 8000) ** (n - 3))) AS p FROM c, i GROUP BY band, f)"""


@query("point_biserial_p_values", views="features",
       oracle=f"WITH {_P_SQL} SELECT band, round(avg(r), 6) AS corr, round(avg(p), 6) AS p_value FROM p GROUP BY band")
def point_biserial_p_values(spark, sf_dir):
    return rounded(scoring.point_biserial(fx.features(spark, sf_dir), ["A", "B"], "y"))


_PSI = "(ln({n} + 8.0) - 1 / (2 * ({n} + 8.0)) - 1 / (12 * ({n} + 8.0) ** 2) + 1 / (120 * ({n} + 8.0) ** 4) - 1 / (252 * ({n} + 8.0) ** 6) - " + " - ".join(
    f"1 / ({{n}} + {i}.0)" for i in range(8)) + ")"


def _psi(n):
    return _PSI.format(n=f"({n})")


_MI_SQL = "l AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS f, id, y, "{c}" AS x FROM features""" for c in COLS) + f"""),
  pairs AS (SELECT a.f, a.id, a.y, a.x, abs(a.x - b.x) AS d, a.y = b.y AS same FROM l a JOIN l b ON a.f = b.f AND a.id <> b.id),
  r AS (SELECT f, id, y, x, d AS r FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY f, id ORDER BY d) = 3),
  m AS (SELECT r.f AS f, r.id AS id, r.y AS y, count(*) FILTER (p.d < r.r) + 1 AS m FROM r JOIN pairs p ON p.f = r.f AND p.id = r.id GROUP BY 1, 2, 3),
  n AS (SELECT f, y, count(*) AS ny FROM l GROUP BY 1, 2), t AS (SELECT f, count(*) AS n FROM l GROUP BY 1),
  mi AS (SELECT f, greatest(0.0, {_psi('any_value(t.n)')} + {_psi('3')} - avg({_psi('n.ny')}) - avg({_psi('m.m')})) AS mi FROM m JOIN n USING (f, y) JOIN t USING (f) GROUP BY f)"""


@query("mutual_information", views="features",
       oracle=f"WITH {_MI_SQL} SELECT left(f, 1) AS feature, round(max(mi), 6) AS MI_score FROM mi GROUP BY 1")
def mutual_information(spark, sf_dir):
    return rounded(scoring.mutual_information(fx.features(spark, sf_dir), ["A", "B"], "y", "id"))


_JOINT_SQL = "l AS (" + " UNION ALL ".join(
    f"""SELECT '{b}' AS f, id, y, [{", ".join(f'"{c}"' for c in lag_columns([b], HISTORY))}] AS x FROM features""" for b in ("A", "B")) + f"""),
  pairs AS (SELECT a.f, a.id, a.y, list_max([{", ".join(f"abs(a.x[{i}] - b.x[{i}])" for i in range(1, 7))}]) AS d, a.y = b.y AS same FROM l a JOIN l b ON a.f = b.f AND a.id <> b.id),
  r AS (SELECT f, id, y, d AS r FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY f, id ORDER BY d) = 3),
  m AS (SELECT r.f AS f, r.id AS id, r.y AS y, count(*) FILTER (p.d < r.r) + 1 AS m FROM r JOIN pairs p ON p.f = r.f AND p.id = r.id GROUP BY 1, 2, 3),
  n AS (SELECT f, y, count(*) AS ny FROM l GROUP BY 1, 2), t AS (SELECT f, count(*) AS n FROM l GROUP BY 1)"""


@query("mutual_information_joint", views="features",
       oracle=f"""WITH {_JOINT_SQL} SELECT f AS feature, round(greatest(0.0, {_psi('any_value(t.n)')} + {_psi('3')} - avg({_psi('n.ny')}) - avg({_psi('m.m')})), 6) AS MI_score
         FROM m JOIN n USING (f, y) JOIN t USING (f) GROUP BY f""")
def mutual_information_joint(spark, sf_dir):
    return rounded(scoring.mutual_information_joint(fx.features(spark, sf_dir), ["A", "B"], "y", "id"))


def _cells(spark, sf_dir):
    row, col = fx.POINT_GRID.cell("lon", "lat")
    cells = fx.points(spark, sf_dir).select("id", row.alias("row"), col.alias("col"))
    return cells.join(fx.features(spark, sf_dir), "id")


_I_SQL = f"""cells AS (SELECT id, CAST(floor((18.0::DOUBLE - lat) / 0.2::DOUBLE) AS INT) AS r, CAST(floor((lon - 103.0::DOUBLE) / 0.2::DOUBLE) AS INT) AS c FROM points),
  knn AS (SELECT a.id AS id, b.id AS other FROM cells a JOIN cells b ON a.id <> b.id
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.r - b.r) ** 2 + (a.c - b.c) ** 2, b.id) <= 8),
  means AS (SELECT {", ".join(f'avg("{c}") AS m{i}' for i, c in enumerate(COLS))} FROM features),
  lag_ AS (SELECT k.id, {", ".join(f'avg("{c}") AS l{i}' for i, c in enumerate(COLS))} FROM knn k JOIN features f ON f.id = k.other GROUP BY k.id),
  i AS (""" + " UNION ALL ".join(
    f"""SELECT '{c[0]}' AS band, sum(("{c}" - m{i}) * (l{i} - m{i})) / sum(("{c}" - m{i}) ** 2) AS v FROM features JOIN lag_ USING (id), means"""
    for i, c in enumerate(COLS)) + ")"


@query("morans_i", views="features points", oracle=f"WITH {_I_SQL} SELECT band, round(max(v), 6) AS I FROM i GROUP BY band")
def morans_i(spark, sf_dir):
    return rounded(scoring.morans_i(_cells(spark, sf_dir), ["A", "B"], 8))


def _ranking(df, columns, label):
    per = scoring.point_biserial_features(df, columns, label)
    order = Window.orderBy(F.desc(F.round("corr", 9)), "feature")  # one row per feature
    return per.select("feature", (F.row_number().over(order) - 1).alias("position"))


@query("consensus_rank", views="samples",
       oracle="WITH " + ", ".join(
           f"s{h} AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS f, abs(corr("{c}", output_{h})) AS s FROM samples""" for c in lag_columns(["V", "K"], HISTORY))
           + f"), r{h} AS (SELECT split_part(f, '_t', 1) AS feature, sum(p) - min(p) AS rank FROM (SELECT f, row_number() OVER (ORDER BY round(s, 9) DESC, f) - 1 AS p FROM s{h}) GROUP BY 1)"
           for h in range(3))
       + """ SELECT feature, CAST(r0.rank AS BIGINT) AS rank_1, CAST(r1.rank AS BIGINT) AS rank_2, CAST(r2.rank AS BIGINT) AS rank_3,
         CAST(r0.rank + r1.rank + r2.rank AS BIGINT) AS points FROM r0 JOIN r1 USING (feature) JOIN r2 USING (feature)""")
def consensus_rank(spark, sf_dir):
    s = fx.samples(spark, sf_dir)
    cols = lag_columns(["V", "K"], HISTORY)
    return scoring.consensus_rank(*[_ranking(s, cols, f"output_{h}") for h in range(3)])


# ---- models -----------------------------------------------------------------


@query("assemble_sequence", views="features",
       oracle=f"""SELECT id, [{", ".join(f'"{b}_t{k:+d}"' for k in HISTORY for b in ("A", "B"))}] AS features FROM features""")
def assemble_sequence(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    out = reshape.assemble_sequence(fx.features(spark, sf_dir), ["A", "B"], HISTORY)
    return out.select("id", vector_to_array("features").alias("features"))


@query("class_weight", views="features",
       oracle="SELECT id, (SELECT count(*) FROM features) / (2 * count(*) OVER (PARTITION BY y)) AS weight FROM features")
def class_weight(spark, sf_dir):
    return models.with_class_weight(fx.features(spark, sf_dir), "y").select("id", "weight")


def _logistic(n):
    return models.scaled_logistic("y", c=1.0, n=n, iterations=100)


def _masks(columns, groups):
    """A list of 0 and 1 per column: whether it belongs to one of ``groups``."""
    return "[" + ", ".join("1.0" if c[0] in groups else "0.0" for c in columns) + "]::DOUBLE[]"


def _rows_sql(columns, table="features", label="y", fold=None):
    """``raw``: id-free rows with the columns as one list."""
    return f"""raw AS (SELECT {fold or "CAST(NULL AS INT)"} AS fold, {label} AS y, [{", ".join(f'"{c}"' for c in columns)}]::DOUBLE[] AS x FROM {table})"""


def _newton_sql(d, name="", steps=12, fits="fits"):
    """CTEs from ``raw`` (fold, y, x) and ``fits`` (fit, mask, without, c) to ``model`` (fit, w,
    m, s): plain Newton steps from 0, each an aggregate of the normal equations and one
    elimination of them, column by column. A masked column has weight 0."""
    cells = range(1, d + 2)
    # Row i of the system: curvature, then the slope; the intercept has no penalty.
    chain = f"""SELECT fit, it, any_value(w) AS w, any_value(mask) AS mask, list(row_ ORDER BY i) AS a FROM (
        SELECT fit, it, i, any_value(w) AS w, any_value(mask) AS mask,
          list_append(list(h ORDER BY j), any_value(g)) AS row_ FROM (
          SELECT n.fit AS fit, n.it AS it, i, j, any_value(n.w) AS w, any_value(n.mask) AS mask,
            sum(z.z[i] * z.z[j] * n_p * (1 - n_p)) + CASE WHEN i = j AND i > 1 THEN 1 / any_value(n.c) ELSE 0 END AS h,
            sum(z.z[i] * (z.y - n_p)) - CASE WHEN i > 1 THEN any_value(n.w)[i] / any_value(n.c) ELSE 0 END AS g
          FROM (SELECT n.*, z.y AS zy, z.z AS zz, 1 / (1 + exp(-list_dot_product(n.w, z.z))) AS n_p FROM newton{name} n JOIN z{name} z USING (fit) WHERE n.it < {steps}) n,
            LATERAL (SELECT n.zy AS y, n.zz AS z) z, range(1, {d + 2}) a(i), range(1, {d + 2}) b(j) GROUP BY n.fit, n.it, i, j) GROUP BY fit, it, i) GROUP BY fit, it"""
    for k in cells:
        rows = ", ".join(
            f"[v / a[{k}][{k}] FOR v IN a[{k}]]" if i == k else f"[a[{i}][j] - a[{i}][{k}] * a[{k}][j] / a[{k}][{k}] FOR j IN range(1, {d + 3})]" for i in cells
        )
        chain = f"SELECT fit, it, w, mask, [{rows}] AS a FROM ({chain})"
    return f"""train{name} AS (SELECT f.fit AS fit, f.mask AS mask, r.y AS y, r.x AS x FROM {fits} f JOIN raw r ON f.without IS NULL OR r.fold <> f.without),
  scale{name} AS (SELECT fit, list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM
    (SELECT fit, i, avg(x[i]) AS m, stddev_samp(x[i]) AS s FROM train{name}, range(1, {d + 1}) t(i) GROUP BY fit, i) GROUP BY fit),
  z{name} AS (SELECT t.fit AS fit, t.y AS y, list_prepend(1.0::DOUBLE, [t.mask[i] * (t.x[i] - c.m[i]) / c.s[i] FOR i IN range(1, {d + 1})]) AS z FROM train{name} t JOIN scale{name} c USING (fit)),
  newton{name} AS (SELECT fit, 0 AS it, [0.0 FOR i IN range(0, {d + 1})]::DOUBLE[] AS w, mask, c FROM {fits}
    UNION ALL SELECT s.fit, s.it + 1, [s.w[i] + s.a[i][{d + 2}] FOR i IN range(1, {d + 2})]::DOUBLE[], s.mask, f.c FROM ({chain}) s JOIN {fits} f USING (fit)),
  model{name} AS (SELECT n.fit AS fit, n.w AS w, n.mask AS mask, c.m AS m, c.s AS s FROM newton{name} n JOIN scale{name} c USING (fit) WHERE n.it = {steps})"""


def _margin_sql(d):
    return f"list_dot_product(m.w, list_prepend(1.0::DOUBLE, [m.mask[i] * (r.x[i] - m.m[i]) / m.s[i] FOR i IN range(1, {d + 1})]))"


# Mean average precision over the folds of the column sets A, B and both.
_CV_SQL = f"""{_rows_sql(COLS, fold=f"CAST({hash_sql('id')} % 5 AS INT)")},
  options AS (SELECT 'A' AS o, {_masks(COLS, "A")} AS mask UNION ALL SELECT 'B', {_masks(COLS, "B")} UNION ALL SELECT 'AB', {_masks(COLS, "AB")}),
  fits AS (SELECT o || k AS fit, o, mask, CAST(k AS INT) AS without, 1.0::DOUBLE AS c FROM options, range(5) t(k)),
  {_newton_sql(len(COLS))},
  held AS (SELECT f.o AS o, r.fold AS fold, {_margin_sql(len(COLS))} AS s, r.y AS y FROM model m JOIN fits f USING (fit) JOIN raw r ON r.fold = f.without),
  steps AS (SELECT o, fold, s, sum(y) AS p, count(*) AS n FROM held GROUP BY o, fold, s),
  run AS (SELECT o, fold, p, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER (PARTITION BY o, fold) AS total FROM steps WINDOW w AS (PARTITION BY o, fold ORDER BY s DESC)),
  cv AS (SELECT o, avg(ap) AS score FROM (SELECT o, fold, sum(p / total * tp / seen) AS ap FROM run GROUP BY o, fold) GROUP BY o),
  single AS (SELECT o, score FROM cv WHERE length(o) = 1 ORDER BY score DESC, o LIMIT 1)"""


@query("forward_selection", views="features",
       oracle=f"""WITH RECURSIVE {_CV_SQL} SELECT 1 AS step, [o] AS bands, 1 AS n_bands, 6 AS n_features, round(score, 6) AS score FROM single
         UNION ALL SELECT 2, [single.o, CASE single.o WHEN 'A' THEN 'B' ELSE 'A' END], 2, 12, round(cv.score, 6) FROM cv, single WHERE cv.o = 'AB'""")
def forward_selection(spark, sf_dir):
    f = fx.features(spark, sf_dir)
    return rounded(models.forward_selection(f, models.band_groups(["A", "B"]), "y", NewtonLogistic(), "id", kind="arithmetic"))


@query("backward_selection", views="features",
       oracle=f"WITH RECURSIVE {_CV_SQL} SELECT 1 AS step, [o] AS bands, 1 AS n_bands, 6 AS n_features, round(score, 6) AS score FROM (SELECT * FROM cv WHERE length(o) = 1 ORDER BY score DESC, o DESC LIMIT 1)")
def backward_selection(spark, sf_dir):
    f = fx.features(spark, sf_dir)
    return rounded(models.backward_selection(f, models.band_groups(["A", "B"]), "y", NewtonLogistic(), "id", kind="arithmetic"))


_RFE = lag_columns(["A", "B", "C"], HISTORY)
_POWER = "SELECT b, avg(abs(w[i + 1])) AS v FROM model{n}, range(1, 19) t(i), LATERAL (SELECT ['A', 'B', 'C'][(i - 1) // 6 + 1] AS b) WHERE mask[i] > 0 GROUP BY b ORDER BY v, b LIMIT 1"


@query("rfe_bands",
       oracle=f"""WITH RECURSIVE {fx._features_sql(3)}, {_rows_sql(_RFE)},
  fits AS (SELECT 1 AS fit, {_masks(_RFE, "ABC")} AS mask, CAST(NULL AS INT) AS without, 1.0::DOUBLE AS c), {_newton_sql(18, "1")},
  gone AS ({_POWER.format(n="1")}),
  fits2 AS (SELECT fit, [CASE WHEN ['A', 'B', 'C'][(i - 1) // 6 + 1] = b THEN 0.0 ELSE 1.0 END FOR i IN range(1, 19)]::DOUBLE[] AS mask, without, c FROM fits, gone), {_newton_sql(18, "2", fits="fits2")},
  gone2 AS ({_POWER.format(n="2")})
  SELECT 1 AS step, b AS dropped, round(v, 6) AS importance FROM gone UNION ALL SELECT 2, b, round(v, 6) FROM gone2""")
def rfe_bands(spark, sf_dir):
    return rounded(models.rfe_bands(fx.features(spark, sf_dir, 3), models.band_groups(["A", "B", "C"]), "y"))


@query("linear_shap", views="features",
       oracle=f"""WITH RECURSIVE {_rows_sql(COLS)}, fits AS (SELECT 1 AS fit, {_masks(COLS, "AB")} AS mask, CAST(NULL AS INT) AS without, 1.0::DOUBLE AS c), {_newton_sql(12)},
  phi AS (SELECT {", ".join(f"(" + " + ".join(f"m.w[{6 * b + i + 1}] / m.s[{6 * b + i}] * (r.x[{6 * b + i}] - m.m[{6 * b + i}])" for i in range(1, 7)) + f") / 6 AS p{b}" for b in range(2))} FROM raw r, model m)
  SELECT 'A' AS band, round(avg(abs(p0)), 6) AS shap FROM phi UNION ALL SELECT 'B', round(avg(abs(p1)), 6) FROM phi""")
def linear_shap(spark, sf_dir):
    return rounded(models.linear_shap(fx.features(spark, sf_dir), models.band_groups(["A", "B"]), "y"))


@query("baseline_models")
def baseline_models(spark, sf_dir):
    """Average precision of both baselines on a hashed fifth."""
    from cellclock.operators.metrics import average_precision
    from cellclock.operators.sampling import train_val_split

    data = models.vectors(models.with_class_weight(fx.features(spark, sf_dir), "y"), COLS)
    train, test = train_val_split(data, ["id"])
    out = None
    for name, est in (("forest", models.forest()), ("logistic", _logistic(train.count()))):
        scored = models.positive_probability(est.fit(train).transform(test))
        row = average_precision(scored, "p").withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("baseline_logistic", views="features",
       oracle=f"""WITH RECURSIVE {_rows_sql(COLS, fold=f"CASE WHEN {hash_sql('id')} % 100 < 80 THEN 1 ELSE 0 END")},
  fits AS (SELECT 1 AS fit, {_masks(COLS, "AB")} AS mask, 0 AS without, 1.0::DOUBLE AS c), {_newton_sql(len(COLS))},
  steps AS (SELECT s, sum(y) AS p, count(*) AS n FROM (SELECT {_margin_sql(len(COLS))} AS s, r.y AS y FROM model m, raw r WHERE r.fold = 0) GROUP BY s),
  run AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER () AS total FROM steps WINDOW w AS (ORDER BY s DESC))
  SELECT round(sum(p / total * tp / seen), 6) AS average_precision FROM run""")
def baseline_logistic(spark, sf_dir):
    """Average precision of the logistic baseline alone on a hashed fifth."""
    from cellclock.operators.metrics import average_precision
    from cellclock.operators.sampling import train_val_split

    train, test = train_val_split(fx.features(spark, sf_dir), ["id"], kind="arithmetic")
    (model,) = fit_logistics(train, [Fit(tuple(COLS))], "y")
    return rounded(average_precision(model.predict(test), "p"))


SLICE = [*lag_columns(["V", "K"], HISTORY)]


def _boosted(spark, sf_dir):
    """What the boosted trees read of the samples, stored: fits pass over them many times."""
    s = fx.samples(spark, sf_dir)
    return models.cut(s.select("sid", *[q(c) for c in lag_columns(["V", "K"], FULL)], *[f"output_{h}" for h in range(HORIZONS)]))


@query("gbt_classifier")
def gbt_classifier(spark, sf_dir):
    s = _boosted(spark, sf_dir)
    train = reshape.sliding_training_rows(models.bounded(s, ["sid"], HORIZONS), ["V", "K"], ["sid"])
    model = models.fit_gbt(train, SLICE, "output_0", ["sid"])
    return models.score_horizons(model, reshape.horizon_slices(s, ["V", "K"], ["sid"]), SLICE, threshold=0.4)


@query("gbt_early_stop")
def gbt_early_stop(spark, sf_dir):
    """All rounds of one ensemble on the six horizon slices, and where it would have stopped."""
    s = _boosted(spark, sf_dir)
    train = models.vectors(reshape.sliding_training_rows(models.bounded(s, ["sid"], HORIZONS), ["V", "K"], ["sid"]), SLICE)
    model = models.gbt("output_0", iterations=12, depth=4).fit(train.withColumn("output_0", F.col("output_0").cast("double")))
    losses = models.cut(models.staged_losses(model, reshape.horizon_slices(s, ["V", "K"], ["sid"]), SLICE))
    return models.early_stop_report(losses, patience=2)


_PRF_SQL = """coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0"""


def _count_sql(by, table):
    counts = ", ".join(f"count(*) FILTER (WHERE {test}) AS {n}" for n, test in {"tp": "y = 1 AND hit", "tn": "y = 0 AND NOT hit", "fp": "y = 0 AND hit", "fn": "y = 1 AND NOT hit"}.items())
    return f"SELECT {by}, {counts} FROM {table} GROUP BY {by}"


@query("score_horizons", views="samples",
       oracle=f"""WITH RECURSIVE slices AS ({" UNION ALL ".join(f"SELECT {h} AS horizon, {slice_sql(h)}, output_{h} AS label FROM samples" for h in range(HORIZONS))}),
  raw AS (SELECT horizon, CAST(NULL AS INT) AS fold, label AS y, [{", ".join(f'"{c}"' for c in SLICE)}]::DOUBLE[] AS x FROM slices WHERE {" AND ".join(f'"{c}" IS NOT NULL' for c in SLICE)}),
  fits AS (SELECT 1 AS fit, {_masks(SLICE, "VK")} AS mask, CAST(NULL AS INT) AS without, 1.0::DOUBLE AS c), {_newton_sql(len(SLICE))},
  hits AS (SELECT r.horizon AS horizon, r.y AS y, 1 / (1 + exp(-{_margin_sql(len(SLICE))})) >= 0.35 AS hit FROM raw r, model m),
  n AS ({_count_sql("horizon", "hits")}), e AS (SELECT *, {_PRF_SQL} FROM n)
  SELECT horizon, tp, tn, fp, fn, round(p1, 6) AS precision_1, round(r1, 6) AS recall_1, round(coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0), 6) AS f1_1,
    round(p0, 6) AS precision_0, round(r0, 6) AS recall_0, round(coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0), 6) AS f1_0 FROM e""")
def score_horizons(spark, sf_dir):
    s = fx.samples(spark, sf_dir)
    train = reshape.sliding_training_rows(s, ["V", "K"], ["sid"])
    (model,) = fit_logistics(train, [Fit(tuple(SLICE))], "output_0")
    return rounded(models.score_horizons(model, reshape.horizon_slices(s, ["V", "K"], ["sid"]), SLICE, threshold=0.35))


_SPACE = {"c": [0.001, 0.01, 0.1, 1.0, 10.0]}
_DRAWN = [choice["c"] for choice in models.drawn_choices(_SPACE, 5)]


@query("random_search", views="features",
       oracle=f"""WITH RECURSIVE {_rows_sql(COLS, fold=f"CAST({hash_sql('id')} % 5 AS INT)")},
  fits AS (SELECT unnest([{", ".join(str(i + 1) for i in range(5))}]) AS fit, {_masks(COLS, "AB")} AS mask, 0 AS without, unnest({_DRAWN}::DOUBLE[]) AS c), {_newton_sql(len(COLS))},
  hits AS (SELECT m.fit AS fit, r.y AS y, 1 / (1 + exp(-{_margin_sql(len(COLS))})) >= 0.5 AS hit FROM model m, raw r WHERE r.fold = 0),
  n AS ({_count_sql("fit", "hits")}), e AS (SELECT *, {_PRF_SQL} FROM n)
  SELECT fit AS step, c, round(coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0), 6) AS score FROM e JOIN fits USING (fit) ORDER BY 3 DESC, 1 LIMIT 1""")
def random_search(spark, sf_dir):
    f = fx.features(spark, sf_dir)
    trials = models.random_search(f, COLS, "y", "id", _SPACE, lambda n, c: NewtonLogistic(c), kind="arithmetic")
    best = best_step(rounded(trials), "step", "score")
    return best.select("step", F.col("params")["c"].cast("double").alias("c"), "score")
