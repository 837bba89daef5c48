"""Classification and regression metrics per horizon, over every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellclock.functions.losses import focal_loss, task_weights
from cellclock.functions.special import pearson
from cellclock.operators.keyed import lookup
from cellclock.operators.ordered import best_step, running_total

EPS = 1e-8  # fixed value


def _finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def confusion_by_horizon(
    df: DataFrame, score: str, threshold: float, y: str = "y", group_by: Sequence[str] = ("horizon",)
) -> DataFrame:
    """tp, tn, fp, fn per group; a positive is ``score >= threshold``. Non-finite
    scores are left out."""
    hit = F.col(score) >= threshold

    def count(test: Column) -> Column:
        return F.sum(F.when(test & _finite(F.col(score)), 1).otherwise(0))

    return df.groupBy(*group_by).agg(
        count((F.col(y) == 1) & hit).alias("tp"),
        count((F.col(y) == 0) & ~hit).alias("tn"),
        count((F.col(y) == 0) & hit).alias("fp"),
        count((F.col(y) == 1) & ~hit).alias("fn"),
    )


def _prf(true: str, wrong: str, missed: str, divide) -> list[Column]:
    precision = divide(F.col(true), F.col(true) + F.col(wrong))
    recall = divide(F.col(true), F.col(true) + F.col(missed))
    return [precision, recall, divide(2 * precision * recall, precision + recall)]


def _with_prf(confusion: DataFrame, divide) -> DataFrame:
    names = ("precision", "recall", "f1")
    one = dict(zip([f"{n}_1" for n in names], _prf("tp", "fp", "fn", divide)))
    zero = dict(zip([f"{n}_0" for n in names], _prf("tn", "fn", "fp", divide)))
    return confusion.withColumns({**one, **zero})


def prf_eps(confusion: DataFrame) -> DataFrame:
    """Precision, recall and F1 of both classes with 1e-8 in each denominator."""
    return _with_prf(confusion, lambda a, b: a / (b + F.lit(EPS)))


def prf_zero_division(confusion: DataFrame) -> DataFrame:
    """The same without epsilon; undefined values are 0."""
    return _with_prf(confusion, lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)))


def _score_counts(df: DataFrame, score: str, y: str, group: list[str], weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score: ties and hot scores collapse
    before anything is sorted."""
    w = F.col(weight) if weight else F.lit(1)
    clean = df.where(_finite(F.col(score)) & F.col(y).isNotNull())
    return clean.groupBy(*group, F.col(score).cast("double").alias("_s")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("_p"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).alias("_n"),
    )


def _curve(df: DataFrame, score: str, y: str, group_by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Cumulative counts from the highest score down, with the totals of a group."""
    group = list(group_by) or ["_all"]
    base = df if group_by else df.withColumn("_all", F.lit(0))
    counts = _score_counts(base, score, y, group)
    curve = running_total(counts, ["_s"], {"_tp": "_p", "_fp": "_n"}, group, descending=True)
    totals = curve.groupBy(*group).agg(F.max("_tp").alias("_all_p"), F.max("_fp").alias("_all_n"))
    return lookup(curve, totals, group, "inner"), group


def _result(df: DataFrame, group: list[str], group_by: Sequence[str], value: Column, name: str) -> DataFrame:
    out = df.groupBy(*group).agg(value.alias(name))
    return out if group_by else out.drop(*group)


def pr_auc(df: DataFrame, score: str, y: str = "y", group_by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under precision over recall, from the point (0, 1). Each
    distinct score is one step, so a step only needs its own counts: the point
    before it is its cumulative count minus its own."""
    curve, group = _curve(df, score, y, group_by)
    before_tp, before_fp = F.col("_tp") - F.col("_p"), F.col("_fp") - F.col("_n")
    here = F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    before = F.coalesce(F.try_divide(before_tp.cast("double"), before_tp + before_fp), F.lit(1.0))
    area = F.try_divide(F.col("_p").cast("double"), F.col("_all_p")) * (here + before) / 2
    return _result(curve, group, group_by, F.sum(area), "pr_auc")


def average_precision(df: DataFrame, score: str, y: str = "y", group_by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times the step in recall."""
    curve, group = _curve(df, score, y, group_by)
    here = F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    step = F.try_divide(F.col("_p").cast("double"), F.col("_all_p")) * here
    return _result(curve, group, group_by, F.sum(step), "average_precision")


def roc_auc(df: DataFrame, score: str, y: str = "y", group_by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties for half; NULL
    when one class is absent."""
    curve, group = _curve(df, score, y, group_by)
    won = F.col("_n").cast("double") * (F.col("_tp") - F.col("_p")) + F.col("_n").cast("double") * F.col("_p") / 2
    pairs = F.max(F.col("_all_p").cast("double") * F.col("_all_n"))
    return _result(curve, group, group_by, F.try_divide(F.sum(won), pairs), "roc_auc")


def mean_loss_by_horizon(df: DataFrame, z: str = "z", y: str = "y", horizon: str = "horizon", loss=None) -> DataFrame:
    """Mean loss of each horizon, and the plain mean of those means beside it."""
    per_row = (loss or focal_loss)(F.col(z), F.col(y))
    per = df.groupBy(horizon).agg(F.avg(per_row).alias("loss"), F.count(F.lit(1)).alias("n"))
    mean = per.agg(F.avg("loss")).scalar()
    return per.select(horizon, "loss", "n", mean.alias("mean_loss"))


def regression_metrics(
    df: DataFrame, y: str = "y", yhat: str = "yhat", group_by: Sequence[str] = ("horizon",)
) -> DataFrame:
    """MAE over all rows; over rows with y > 0 also MAE, RMSE and the Kling-Gupta
    efficiency (population deviations). Undefined values are NULL: fewer than two
    positives, or a constant series."""
    t, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    pos = F.col(y) > 0
    tp, pp = F.when(pos, t), F.when(pos, p)
    raw = df.groupBy(*group_by).agg(
        F.avg(F.abs(t - p)).alias("mae"),
        F.count(tp).alias("positives"),
        F.avg(F.abs(tp - pp)).alias("_mae"),
        F.sqrt(F.avg((tp - pp) * (tp - pp))).alias("_rmse"),
        pearson(tp, pp).alias("_r"),
        F.avg(tp).alias("_mt"),
        F.avg(pp).alias("_mp"),
        F.stddev_pop(tp).alias("_st"),
        F.stddev_pop(pp).alias("_sp"),
    )
    enough = F.col("positives") > 1
    beta = F.try_divide(F.col("_mp"), F.col("_mt"))
    gamma = F.try_divide(F.try_divide(F.col("_sp"), F.col("_mp")), F.try_divide(F.col("_st"), F.col("_mt")))
    kge = 1 - F.sqrt(F.pow(F.col("_r") - 1, F.lit(2)) + F.pow(beta - 1, F.lit(2)) + F.pow(gamma - 1, F.lit(2)))
    return raw.select(
        *group_by,
        "mae",
        "positives",
        F.when(enough, F.col("_mae")).alias("mae_nonzero"),
        F.when(enough, F.col("_rmse")).alias("rmse_nonzero"),
        F.when(enough & ~F.isnan("_r"), kge).alias("kge_nonzero"),
    )


def r2_from_sums(
    df: DataFrame, y: str = "y", yhat: str = "yhat", group_by: Sequence[str] = ("horizon",)
) -> DataFrame:
    """R2 = 1 - SSres / (sum y^2 - (sum y)^2 / n), 0 when the total is not positive;
    and the mean absolute error."""
    t, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    sums = df.groupBy(*group_by).agg(
        F.avg(F.abs(t - p)).alias("mae"),
        F.sum((t - p) * (t - p)).alias("_res"),
        (F.sum(t * t) - F.sum(t) * F.sum(t) / F.count(t)).alias("_tot"),
    )
    r2 = F.when(F.col("_tot") > 0, 1 - F.try_divide(F.col("_res"), F.col("_tot"))).otherwise(0.0)
    return sums.select(*group_by, "mae", r2.alias("r2"))


def composite_score(pr_auc: Column, mae: Column, r2: Column, log_var_reg: float, log_var_cls: float) -> Column:
    """w_c * PR-AUC + w_r * (half 1/(1+MAE) + half R2 clipped to [0, 1])."""
    w_cls, w_reg = task_weights(log_var_reg, log_var_cls)
    good = F.lit(0.5) / (1 + mae) + F.lit(0.5) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2))
    return w_cls * pr_auc + w_reg * good


def threshold_sweep(
    df: DataFrame, score: str, thresholds: Sequence[float], y: str = "y", group_by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and F1 at each threshold. Rows are counted once per score
    interval between thresholds; the sweep then runs over those few counts."""
    group = list(group_by) or ["_all"]
    base = df if group_by else df.withColumn("_all", F.lit(0))
    cuts = sorted(thresholds)
    passed = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in cuts), F.lit(0))
    counts = base.where(_finite(F.col(score)) & F.col(y).isNotNull()).groupBy(*group, passed.alias("_k")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("_p"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("_n"),
    )

    def total(c: str, test: Column) -> Column:
        return F.sum(F.when(test, F.col(c)).otherwise(0))

    rows = []
    aggs = []
    for i, t in enumerate(cuts):
        over = F.col("_k") > i
        for name, c, test in (("tp", "_p", over), ("fp", "_n", over), ("fn", "_p", ~over), ("tn", "_n", ~over)):
            aggs.append(total(c, test).alias(f"{name}_{i}"))
        rows.append(
            F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in ("tp", "tn", "fp", "fn")])
        )
    wide = counts.groupBy(*group).agg(*aggs)
    long = wide.select(*group, F.explode(F.array(*rows)).alias("_r")).select(*group, "_r.*")
    out = prf_zero_division(long)
    return out if group_by else out.drop("_all")


def best_threshold(sweep: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """The threshold of the best F1, the lowest on a tie."""
    return best_step(sweep, "threshold", "f1_1", group_by)
