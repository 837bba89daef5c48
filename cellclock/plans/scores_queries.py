"""Metrics, feature scores and models on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellclock.functions import losses
from cellclock.names import q
from cellclock.operators import metrics
from cellclock.plans import fixtures as fx
from cellclock.plans.profiles_queries import rounded
from cellclock.plans.registry import query

_CONF = """c AS (SELECT horizon, count(*) FILTER (y = 1 AND hit) AS tp, count(*) FILTER (y = 0 AND NOT hit) AS tn,
  count(*) FILTER (y = 0 AND hit) AS fp, count(*) FILTER (y = 1 AND NOT hit) AS fn
  FROM (SELECT *, 1 / (1 + exp(-z)) >= 0.4::DOUBLE AS hit FROM scored) GROUP BY horizon)"""


def _scored(spark, sf_dir):
    return fx.scored(spark, sf_dir).withColumn("p", losses.sigmoid(F.col("z")))


def _confusion(spark, sf_dir):
    return metrics.confusion_by_horizon(_scored(spark, sf_dir), "p", 0.4)


@query("confusion_by_horizon", views="scored", oracle=f"WITH {_CONF} SELECT * FROM c")
def confusion_by_horizon(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query("prf_eps", views="scored",
       oracle=f"""WITH {_CONF}, e AS (SELECT *, tp / (tp + fp + 1e-8) AS p1, tp / (tp + fn + 1e-8) AS r1, tn / (tn + fn + 1e-8) AS p0, tn / (tn + fp + 1e-8) AS r0 FROM c)
         SELECT horizon, tp, tn, fp, fn, round(p1, 6) AS precision_1, round(r1, 6) AS recall_1, round(2 * p1 * r1 / (p1 + r1 + 1e-8), 6) AS f1_1,
           round(p0, 6) AS precision_0, round(r0, 6) AS recall_0, round(2 * p0 * r0 / (p0 + r0 + 1e-8), 6) AS f1_0 FROM e""")
def prf_eps(spark, sf_dir):
    return rounded(metrics.prf_eps(_confusion(spark, sf_dir)))


@query("prf_zero_division", views="scored",
       oracle=f"""WITH {_CONF}, e AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
           coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0 FROM c)
         SELECT horizon, tp, tn, fp, fn, round(p1, 6) AS precision_1, round(r1, 6) AS recall_1, round(coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0), 6) AS f1_1,
           round(p0, 6) AS precision_0, round(r0, 6) AS recall_0, round(coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0), 6) AS f1_0 FROM e""")
def prf_zero_division(spark, sf_dir):
    return rounded(metrics.prf_zero_division(_confusion(spark, sf_dir)))


_CURVE = """g AS (SELECT horizon, {s} AS s, sum(y) AS p, sum(1 - y) AS n FROM {t} GROUP BY ALL),
  c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY horizon) AS P_, sum(n) OVER (PARTITION BY horizon) AS N_ FROM g WINDOW w AS (PARTITION BY horizon ORDER BY s DESC)),
  v AS (SELECT *, tp / (tp + fp) AS pr, tp / P_ AS rc, lag(tp / (tp + fp), 1, 1.0::DOUBLE) OVER w AS pr0, lag(tp / P_, 1, 0.0::DOUBLE) OVER w AS rc0 FROM c WINDOW w AS (PARTITION BY horizon ORDER BY s DESC))"""
_AREAS = {
    "pr_auc": "round(sum((rc - rc0) * (pr + pr0) / 2), 6)",
    "average_precision": "round(sum((rc - rc0) * pr), 6)",
    "roc_auc": "round(sum(n * ((tp - p) + p / 2.0::DOUBLE)) / any_value(P_ * N_), 6)",
}
for _name, _expr in _AREAS.items():

    def _tied(spark, sf_dir, name=_name):
        return rounded(getattr(metrics, name)(fx.scored(spark, sf_dir), "z", group_by=["horizon"]))

    def _fine(spark, sf_dir, name=_name):
        return rounded(getattr(metrics, name)(fx.fine_scored(spark, sf_dir), "score", group_by=["horizon"]))

    query(_name, views="scored",
          oracle=f"WITH {_CURVE.format(s='z', t='scored')} SELECT horizon, {_expr} AS {_name} FROM v GROUP BY horizon")(_tied)
    query(f"{_name}_fine", views="fine_scored",
          oracle=f"WITH {_CURVE.format(s='score', t='fine_scored')} SELECT horizon, {_expr} AS {_name} FROM v GROUP BY horizon")(_fine)

_BCE = "(greatest(z, 0.0) - z * y + ln(1 + exp(-abs(z))))"
_FOCAL = f"((0.25::DOUBLE * y + 0.75::DOUBLE * (1 - y)) * (1 - exp(-{_BCE})) ** 2.0 * {_BCE})"


@query("mean_loss_by_horizon", views="scored",
       oracle=f"""WITH h AS (SELECT horizon, avg({_FOCAL}) AS loss, count(*) AS n FROM scored GROUP BY 1)
         SELECT horizon, round(loss, 6) AS loss, n, round((SELECT avg(loss) FROM h), 6) AS mean_loss FROM h""")
def mean_loss_by_horizon(spark, sf_dir):
    return rounded(metrics.mean_loss_by_horizon(fx.scored(spark, sf_dir)))


_KGE = """1 - sqrt((corr(y, yhat) - 1) ** 2 + (avg(yhat) / avg(y) - 1) ** 2
  + ((stddev_pop(yhat) / avg(yhat)) / (stddev_pop(y) / avg(y)) - 1) ** 2)"""


@query("regression_metrics", views="regress",
       oracle=f"""WITH a AS (SELECT horizon, avg(abs(y - yhat)) AS mae FROM regress GROUP BY 1),
         b AS (SELECT horizon, count(*) AS positives, avg(abs(y - yhat)) AS m, sqrt(avg((y - yhat) ** 2)) AS r, {_KGE} AS k FROM regress WHERE y > 0 GROUP BY 1)
         SELECT horizon, round(mae, 4) AS mae, positives, round(m, 4) AS mae_nonzero, round(r, 4) AS rmse_nonzero, round(k, 4) AS kge_nonzero FROM a JOIN b USING (horizon)""")
def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(fx.regress(spark, sf_dir)), 4)


_R2 = """r AS (SELECT horizon, avg(abs(y - yhat)) AS mae, CASE WHEN sum(y * y) - sum(y) ** 2 / count(*) > 0
  THEN 1 - sum((y - yhat) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*)) ELSE 0 END AS r2 FROM regress GROUP BY 1)"""


@query("r2_from_sums", views="regress", oracle=f"WITH {_R2} SELECT horizon, round(mae, 4) AS mae, round(r2, 6) AS r2 FROM r")
def r2_from_sums(spark, sf_dir):
    out = metrics.r2_from_sums(fx.regress(spark, sf_dir))
    return out.select("horizon", F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query("composite_score", views="scored regress",
       oracle=f"""WITH {_CURVE.format(s='z', t='scored')}, {_R2}, a AS (SELECT avg(x) AS pr FROM (SELECT horizon, sum((rc - rc0) * (pr + pr0) / 2) AS x FROM v GROUP BY 1)),
         b AS (SELECT avg(mae) AS mae, avg(r2) AS r2 FROM r), w AS (SELECT exp(3.0) / (exp(3.0) + exp(2.0) + 1e-12) AS wc, exp(2.0) / (exp(3.0) + exp(2.0) + 1e-12) AS wr)
         SELECT round(wc * pr + wr * (0.5 / (1 + mae) + 0.5 * greatest(0.0, least(1.0, r2))), 6) AS score FROM a, b, w""")
def composite_score(spark, sf_dir):
    pr = metrics.pr_auc(fx.scored(spark, sf_dir), "z", group_by=["horizon"]).agg(F.avg("pr_auc")).scalar()
    reg = metrics.r2_from_sums(fx.regress(spark, sf_dir)).agg(F.avg("mae").alias("mae"), F.avg("r2").alias("r2"))
    score = metrics.composite_score(pr, F.col("mae"), F.col("r2"), log_var_reg=-2.0, log_var_cls=-3.0)
    return reg.select(F.round(score, 6).alias("score"))


_SWEEP = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
_SWEEP_SQL = f"""t AS (SELECT unnest({[float(t) for t in _SWEEP]}::DOUBLE[]) AS threshold),
  c AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p < threshold) AS tn,
    count(*) FILTER (y = 0 AND p >= threshold) AS fp, count(*) FILTER (y = 1 AND p < threshold) AS fn
    FROM (SELECT y, 1 / (1 + exp(-z)) AS p FROM scored), t GROUP BY 1),
  f AS (SELECT threshold, tp, tn, fp, fn, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)"""


@query("threshold_sweep", views="scored", oracle=f"WITH {_SWEEP_SQL} SELECT threshold, tp, tn, fp, fn, round(f1, 6) AS f1_1 FROM f")
def threshold_sweep(spark, sf_dir):
    out = metrics.threshold_sweep(_scored(spark, sf_dir), "p", _SWEEP)
    return out.select("threshold", "tp", "tn", "fp", "fn", F.round("f1_1", 6).alias("f1_1"))


@query("best_threshold", views="scored", oracle=f"WITH {_SWEEP_SQL} SELECT threshold, round(f1, 6) AS f1_1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    out = metrics.best_threshold(metrics.threshold_sweep(_scored(spark, sf_dir), "p", _SWEEP))
    return out.select("threshold", F.round("f1_1", 6).alias("f1_1"))
