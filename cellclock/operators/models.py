"""Spark ML baselines, stepwise selection, search and scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellclock.names import HISTORY, lag_columns, q
from cellclock.operators.metrics import average_precision, confusion_by_horizon, prf_zero_division
from cellclock.operators.newton import Fit, Fitted, NewtonLogistic, fit_logistics, held_out_scores
from cellclock.operators.sampling import row_hash, stratified_folds, union_rows
from cellclock.session import cut

PART_ROWS = 200_000  # training rows of a partition


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (2 * n_class): both classes weigh the same, a NULL label nothing. Counts are
    a scalar row."""
    counts = df.agg(
        F.struct(
            F.count(q(label)).alias("n"), F.sum(F.when(q(label) == 1, 1).otherwise(0)).alias("p")
        )
    ).scalar()
    mine = F.when(q(label) == 1, counts.getField("p")).otherwise(counts.getField("n") - counts.getField("p"))
    return df.withColumn(name, F.when(q(label).isNull(), 0.0).otherwise(F.try_divide(counts.getField("n").cast("double"), 2 * mine)))


def forest(label: str = "y", features: str = "features", trees: int = 120, depth: int = 10, seed: int = 42):
    return RandomForestClassifier(
        labelCol=label, featuresCol=features, weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=10, featureSubsetStrategy="sqrt", subsamplingRate=0.8, seed=seed,
    )


def scaled_logistic(label: str = "y", features: str = "features", c: float = 1.0, n: int | None = None, iterations: int = 100):
    """Standardised inputs, then an L2 logistic fit with strength 1 / (C * n)."""
    scaler = StandardScaler(inputCol=features, outputCol=f"{features}_scaled", withMean=True, withStd=True)
    fit = LogisticRegression(
        labelCol=label, featuresCol=f"{features}_scaled", regParam=1.0 / (c * n) if n else 0.0,
        elasticNetParam=0.0, standardization=False, maxIter=iterations,
    )
    return Pipeline(stages=[scaler, fit])


def vectors(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="skip").transform(df)


def bounded(df: DataFrame, key: Sequence[str], copies: int = 1) -> DataFrame:
    """``df`` in as many hash partitions as it takes for PART_ROWS training rows in each,
    where a row becomes ``copies`` of them. Tree fits hold and read their input by
    partition, in a form many times as large as the shuffle that adaptive execution
    coalesces by. ``df`` is counted, so it should be a stored table."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() * copies // PART_ROWS))
    return df.repartition(parts, *key)


def positive_probability(predictions: DataFrame, name: str = "p") -> DataFrame:
    return predictions.withColumn(name, vector_to_array("probability")[1])


def cross_val_scores(
    df: DataFrame,
    options: Sequence[Sequence[str]],
    label: str,
    estimator: Estimator | NewtonLogistic,
    fold: str = "fold",
    folds: int = 5,
) -> list[float]:
    """Mean average precision over the folds, for several column sets. ``estimator`` may
    be a function of the number of training rows.

    With ``NewtonLogistic`` all folds of all options are one batch of fits, a Spark job a
    step. Of other estimators every fit is a job of its own. The held-out rows of all fits
    are scored in one job, grouped by option and fold, of which one number per option
    comes back.
    """
    if isinstance(estimator, NewtonLogistic):
        fits = [Fit(tuple(columns), estimator, i) for columns in options for i in range(folds)]
        names = [o for o in range(len(options)) for _ in range(folds)]
        return _option_means(held_out_scores(df, fits, fit_logistics(df, fits, label, fold), names, label, fold))
    held = []
    sizes = dict(df.groupBy(fold).count().collect()) if callable(estimator) else {}
    for o, columns in enumerate(options):
        data = vectors(df, columns)
        for i in range(folds):
            fresh = estimator(sum(sizes.values()) - sizes.get(i, 0)) if callable(estimator) else estimator
            model = fresh.fit(data.where(F.col(fold) != i))
            scored = positive_probability(model.transform(data.where(F.col(fold) == i)))
            held.append(scored.select(F.lit(o).alias("option"), F.lit(i).alias("fold"), "p", q(label).alias("y")))
    return _option_means(union_rows(*held))


def _option_means(scored: DataFrame) -> list[float]:
    per_fold = average_precision(scored, "p", "y", ["option", "fold"])
    means = per_fold.groupBy("option").agg(F.avg("average_precision").alias("score")).collect()  # one row per option
    return [score for _, score in sorted((r["option"], r["score"]) for r in means)]


HISTORY_SCHEMA = "step int, bands array<string>, n_bands int, n_features int, score double"


def _selection(df, groups, label, estimator, key, folds, backward, kind):
    data = cut(stratified_folds(with_class_weight(df, label), [key], None, folds, kind=kind))
    current = list(groups) if backward else []
    history = []

    def flat(names):
        return [c for g in names for c in groups[g]]

    while (len(current) > 1) if backward else (len(current) < len(groups)):
        if backward:
            options = [[g for g in current if g != gone] for gone in current]
        else:
            options = [[*current, g] for g in groups if g not in current]
        scores = cross_val_scores(data, [flat(o) for o in options], label, estimator, folds=folds)
        score, current = max(zip(scores, options), key=lambda s: s[0])  # first option on a tie
        history.append((len(history) + 1, list(current), len(current), len(flat(current)), score))
    return df.sparkSession.createDataFrame(history, HISTORY_SCHEMA)


def band_groups(bands: Sequence[str], offsets: Sequence[int] = HISTORY) -> dict[str, list[str]]:
    """A band stands for all its lags."""
    return {b: lag_columns([b], offsets) for b in bands}


def forward_selection(
    df: DataFrame, groups: Mapping[str, Sequence[str]], label: str, estimator: Estimator | NewtonLogistic, key: str, folds: int = 5,
    kind: str = "xxhash64",
) -> DataFrame:
    """Greedy addition of the group that helps the cross-validated average precision
    most; one history row per step. Groups of one column give the per-feature form."""
    return _selection(df, groups, label, estimator, key, folds, False, kind)


def backward_selection(
    df: DataFrame, groups: Mapping[str, Sequence[str]], label: str, estimator: Estimator | NewtonLogistic, key: str, folds: int = 5,
    kind: str = "xxhash64",
) -> DataFrame:
    """Greedy removal, down to one group."""
    return _selection(df, groups, label, estimator, key, folds, True, kind)


def rfe_bands(df: DataFrame, groups: Mapping[str, Sequence[str]], label: str, keep: int = 1, c: float = 1.0) -> DataFrame:
    """Recursive elimination: scale, fit a logistic model, drop the group of the
    smallest mean |coefficient|, the first on a tie. Rows that lack any column are left
    out from the start. Rows ``step, dropped, importance`` in drop order."""
    columns = [x for g in groups.values() for x in g]
    data = cut(df.na.drop(subset=columns).select(q(label).alias(label), *[q(x) for x in columns]))
    left, dropped = list(groups), []
    while len(left) > keep:
        names = tuple(x for g in left for x in groups[g])
        (model,) = fit_logistics(data, [Fit(names, NewtonLogistic(c))], label)
        weights = dict(zip(names, model.weights))
        power = {g: sum(abs(float(weights[x])) for x in groups[g]) / len(groups[g]) for g in left}
        worst = min(left, key=power.get)
        dropped.append((len(dropped) + 1, worst, power[worst]))
        left.remove(worst)
    return df.sparkSession.createDataFrame(dropped, "step int, dropped string, importance double")


def linear_shap(
    df: DataFrame, groups: Mapping[str, Sequence[str]], label: str, c: float = 1.0
) -> DataFrame:
    """Mean |attribution| per group under a linear model: phi = w (x - E x) per
    column, averaged over the group's time steps per row, then over rows."""
    columns = tuple(x for g in groups.values() for x in g)
    data = df.na.drop(subset=list(columns))
    (model,) = fit_logistics(data, [Fit(columns, NewtonLogistic(c))], label)
    w, mean = model.slopes(), dict(zip(columns, model.mean))
    aggs, cells = [], []
    for i, (g, names) in enumerate(groups.items()):
        phi = sum((F.lit(w[x]) * (q(x) - F.lit(float(mean[x]))) for x in names), F.lit(0.0)) / len(names)
        aggs.append(F.avg(F.abs(phi)).alias(f"s{i}"))
        cells.append(F.struct(F.lit(g).alias("band"), F.col(f"s{i}").alias("shap")))
    return data.agg(*aggs).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").orderBy(F.desc("shap"), "band")


def score_horizons(model, slices: DataFrame, columns: Sequence[str], threshold: float = 0.5, label: str = "label") -> DataFrame:
    """Precision, recall and F1 of a fitted model on every horizon slice at once."""
    scored = model.predict(slices) if isinstance(model, Fitted) else positive_probability(model.transform(vectors(slices, columns)))
    confusion = confusion_by_horizon(scored, "p", threshold, label)
    return prf_zero_division(confusion).orderBy("horizon")


def gbt(label: str, iterations: int = 20, depth: int = 5, seed: int = 42) -> GBTClassifier:
    """Boosted trees without a stop of their own, for ``staged_losses``."""
    return GBTClassifier(labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, seed=seed)


def fit_gbt(
    train: DataFrame, columns: Sequence[str], label: str, key: Sequence[str], iterations: int = 20, depth: int = 5,
    tolerance: float = 0.01, seed: int = 42,
):
    """Boosted trees that stop when a hashed 20 % validation share no longer gains."""
    data = vectors(train, columns).withColumn("_val", F.pmod(row_hash(key, seed), F.lit(100)) >= 80)
    gbt = GBTClassifier(
        labelCol=label, featuresCol="features", validationIndicatorCol="_val", maxIter=iterations, maxDepth=depth,
        validationTol=tolerance, seed=seed,
    )
    return gbt.fit(data.withColumn(label, q(label).cast("double")))


def staged_losses(model, slices: DataFrame, columns: Sequence[str], label: str = "label", by: str = "horizon", threshold: float = 0.5) -> DataFrame:
    """(``by``, round, n, loss, precision_1, recall_1, f1_1) of an ensemble cut after each
    of its rounds, from one pass over the slices: every tree is applied once, and running
    sums of their votes give all rounds at the same time. ``loss`` is the mean log loss."""
    data = vectors(slices, columns)
    names = [f"_vote{i}" for i in range(len(model.trees))]
    for name, tree in zip(names, model.trees):
        data = tree.setFeaturesCol("features").setPredictionCol(name).transform(data)
    votes = F.array(*[F.col(n) * F.lit(float(w)) for n, w in zip(names, model.treeWeights)])
    rounds = F.array(*[F.lit(i) for i in range(1, len(names) + 1)])
    margins = F.transform(rounds, lambda i: F.aggregate(F.slice("_votes", 1, i), F.lit(0.0), lambda total, v: total + v))
    staged = data.select(q(by).alias(by), q(label).cast("int").alias("_y"), votes.alias("_votes"))
    staged = staged.select(by, "_y", F.posexplode(margins).alias("_at", "_m"))
    y, m = F.col("_y"), F.col("_m")
    guess = F.lit(1) / (1 + F.exp(-2 * m)) >= threshold
    counted = staged.groupBy(by, (F.col("_at") + 1).cast("int").alias("round")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.log1p(F.exp(-F.abs(2 * m))) + F.greatest(F.lit(0.0), F.when(y == 1, -2 * m).otherwise(2 * m))).alias("loss"),
        F.sum((guess & (y == 1)).cast("long")).alias("_tp"),
        F.sum((guess & (y == 0)).cast("long")).alias("_fp"),
        F.sum((~guess & (y == 1)).cast("long")).alias("_fn"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = share(F.col("_tp"), F.col("_tp") + F.col("_fp")), share(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    scored = counted.withColumns({"precision_1": p, "recall_1": r})
    return scored.withColumn("f1_1", share(2 * F.col("precision_1") * F.col("recall_1"), F.col("precision_1") + F.col("recall_1"))).drop("_tp", "_fp", "_fn")


def early_stop_report(losses: DataFrame, patience: int, by: str = "horizon", decides=None) -> DataFrame:
    """Where boosting with ``patience`` stops and what it keeps: one row per ``by`` with
    stop_round, best_round, best_score (the loss of the deciding set there), and the own
    loss, precision, recall and F1 of the set at best_round.

    As with several evaluation sets, one of them decides: ``decides``, by default the last.
    Training stops at the first round that is ``patience`` rounds past the best so far, or
    at the last. ``losses`` comes from ``staged_losses``: a row per set and round."""
    chosen = losses.agg(F.max(by)).first()[0] if decides is None else decides
    rounds = losses.where(F.col(by) == F.lit(chosen)).select("round", "loss")
    so_far = Window.orderBy("round")  # a row for each round
    best = rounds.withColumn("_best", F.min(F.struct("loss", "round")).over(so_far))
    over = best.where(F.col("round") - F.col("_best.round") >= patience)
    stop = over.select(F.min("round")).first()[0] or rounds.select(F.max("round")).first()[0]
    if stop is None:
        return losses.select(by, F.lit(None).cast("int").alias("stop_round"), F.col("round").alias("best_round"), F.col("loss").alias("best_score"), "loss", "precision_1", "recall_1", "f1_1")
    kept = best.where(F.col("round") == stop).select("_best.loss", "_best.round").first()
    at_best = losses.where(F.col("round") == kept["round"])
    return at_best.select(by, F.lit(stop).alias("stop_round"), F.col("round").alias("best_round"), F.lit(kept["loss"]).alias("best_score"), "loss", "precision_1", "recall_1", "f1_1")


def random_search(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    key: str,
    space: Mapping[str, Sequence],
    make,
    trials: int = 5,
    seed: int = 42,
    threshold: float = 0.5,
    kind: str = "xxhash64",
) -> DataFrame:
    """Seeded random choices from ``space``; ``make(n, **choice)`` builds the estimator for
    ``n`` training rows. Where all are ``NewtonLogistic`` the trials are one batch of fits.
    One history row per trial with its F1 on the held-out fifth."""
    marked = with_class_weight(df, label).withColumn("_h", F.pmod(row_hash([key], seed, kind), F.lit(5)))
    n = marked.where("_h > 0").count()
    choices = drawn_choices(space, trials, seed)
    estimators = [make(n, **choice) for choice in choices]
    if all(isinstance(e, NewtonLogistic) for e in estimators):
        data = cut(marked)
        fits = [Fit(tuple(columns), e, 0) for e in estimators]
        held = held_out_scores(data, fits, fit_logistics(data, fits, label, "_h"), range(trials), label, "_h")
    else:
        data = cut(vectors(marked, columns))
        train, rest = data.where("_h > 0"), data.where("_h = 0")
        scored = [positive_probability(e.fit(train).transform(rest)) for e in estimators]
        held = union_rows(*[s.select(F.lit(i).alias("option"), "p", q(label).alias("y")) for i, s in enumerate(scored)])
    f1 = prf_zero_division(confusion_by_horizon(held.withColumnRenamed("option", "horizon"), "p", threshold, "y"))
    found = {r["horizon"]: r["f1_1"] for r in f1.collect()}  # one row per trial
    rows = [(i + 1, {k: str(v) for k, v in choice.items()}, float(found.get(i, 0.0))) for i, choice in enumerate(choices)]
    return df.sparkSession.createDataFrame(rows, "step int, params map<string,string>, score double")


def drawn_choices(space: Mapping[str, Sequence], trials: int, seed: int = 42) -> list[dict]:
    """The seeded choices of ``random_search``."""
    import random

    rng = random.Random(seed)
    return [{name: rng.choice(list(values)) for name, values in space.items()} for _ in range(trials)]
