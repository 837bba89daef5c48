"""Logistic fits by Newton steps: many fits at a time, one pass over the rows a step.

Every step is one Spark job. Tasks add up gradient, curvature and loss of all fits that
are still moving, in numpy over whole batches, and an aggregate adds the tasks' sums. What
comes back is d (d + 5) / 2 + 2 numbers of a fit with d columns, whatever the number of
rows; the small system is solved beside the plan. Folds and column sets of a selection
step are fits of one batch, so a step of a selection costs about six passes, not one
optimiser run per fold and set.

A fit minimises the summed log loss plus |w|^2 / (2 c) over standardised columns (sample
deviation, the intercept free). Rows that lack a label, a fold where one is left out, or a
finite value in a column of the fit are no part of it. A column without spread has weight 0. Without both
classes all weights are 0 and every probability is that of the one class (of an empty
table: NULL).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellclock.names import q


def _finite(name: str):
    """The column as a double, NULL where it is NaN or infinite."""
    value = q(name).cast("double")
    return F.when(F.abs(value) < float("inf"), value)


@dataclass(frozen=True)
class NewtonLogistic:
    """What to fit: strength 1 / c of the penalty, at most ``steps`` accepted steps."""

    c: float = 1.0
    steps: int = 50
    tolerance: float = 1e-9


@dataclass(frozen=True)
class Fit:
    """One fit of a batch: its columns, and the fold it must not see."""

    columns: tuple[str, ...]
    settings: NewtonLogistic = NewtonLogistic()
    without: int | None = None


@dataclass(frozen=True)
class Fitted:
    """A fit's outcome. ``weights`` belong to standardised columns."""

    columns: tuple[str, ...]
    intercept: float | None
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    steps: int
    converged: bool

    def slopes(self) -> dict[str, float]:
        """Weights of the columns as they are."""
        return {c: w / s if s else 0.0 for c, w, s in zip(self.columns, self.weights, self.std)}

    def probability(self):
        """The probability of label 1 as a column; NULL where a column is missing or not finite."""
        if self.intercept is None:
            return F.lit(None).cast("double")
        margin = F.lit(float(self.intercept))
        for c, w, m, s in zip(self.columns, self.weights, self.mean, self.std):
            margin = margin + F.lit(float(w)) * ((_finite(c) - F.lit(float(m))) / F.lit(float(s or 1.0)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        """``df`` without rows that lack a column, with the probability as ``name``."""
        scored = df.withColumn(name, self.probability())
        return scored if self.intercept is None else scored.where(q(name).isNotNull())


def _added(rows: DataFrame, sums, fits: int) -> list:
    """Sums over all rows: ``sums(x, y, fold)`` gives for each fit an array for one batch;
    tasks add their batches, Spark adds the tasks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])
            found = sums(table[2:].T, table[0], table[1])
            total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([t.tolist() for t in total], pa.list_(pa.float64()))], names=["fit", "sums"]
            )

    parts = rows.mapInArrow(run, "fit int, sums array<double>").select("fit", F.posexplode("sums").alias("at", "v"))
    out: list[dict] = [{} for _ in range(fits)]
    for r in parts.groupBy("fit", "at").agg(F.sum("v").alias("v")).collect():
        out[r["fit"]][r["at"]] = r["v"]
    return [[found[i] for i in range(len(found))] for found in out]


def _moments(places, without, centre):
    def sums(x, y, fold):
        import numpy as np

        out = []
        for at, out_fold in zip(places, without):
            part = x[:, at] - centre[at]
            keep = ~np.isnan(part).any(axis=1) & ~np.isnan(y)
            if out_fold is not None:
                keep &= (fold != out_fold) & ~np.isnan(fold)
            part, label = part[keep], y[keep]
            out.append(np.concatenate([[len(part), label.sum()], part.sum(axis=0), (part * part).sum(axis=0)]))
        return out

    return sums


def _slopes(places, without, means, stds, weights):
    def sums(x, y, fold):
        import numpy as np

        out = []
        for at, out_fold, mean, std, w in zip(places, without, means, stds, weights):
            part = (x[:, at] - mean) / std
            keep = ~np.isnan(part).any(axis=1) & ~np.isnan(y)
            if out_fold is not None:
                keep &= (fold != out_fold) & ~np.isnan(fold)
            z = np.column_stack([np.ones(keep.sum()), part[keep]])
            label, margin = y[keep], z @ w
            p = 0.5 * (1 + np.tanh(margin / 2))
            curve = (z * (p * (1 - p))[:, None]).T @ z
            loss = np.logaddexp(0, margin).sum() - (label * margin).sum()
            out.append(np.concatenate([[loss], z.T @ (label - p), curve[np.triu_indices(len(w))]]))
        return out

    return sums


def fit_logistics(df: DataFrame, fits: Sequence[Fit], label: str, fold: str | None = None) -> list[Fitted]:
    """All ``fits`` at the same time. ``df`` is read once for the means, once for the
    spreads and once a step; give it as a table if it is dear to compute."""
    import numpy as np

    columns = list(dict.fromkeys(c for f in fits for c in f.columns))
    if not fits:
        return []
    rows = df.select(
        q(label).cast("double").alias("_y"),
        (q(fold).cast("double") if fold else F.lit(0.0)).alias("_fold"),
        *[_finite(c).alias(f"_x{i}") for i, c in enumerate(columns)],
    )
    middle = rows.agg(*[F.avg(f"_x{i}") for i in range(len(columns))]).first()
    centre = np.array([0.0 if v is None else v for v in middle])
    places = [[columns.index(c) for c in f.columns] for f in fits]
    without = [f.without for f in fits]

    fitted: list[Fitted | None] = [None] * len(fits)
    moving = []
    for i, found in enumerate(_added(rows, _moments(places, without, centre), len(fits))):
        d = len(places[i])
        n, ones = (found[0], found[1]) if found else (0.0, 0.0)
        first = np.array(found[2 : 2 + d]) if found else np.zeros(d)
        second = np.array(found[2 + d :]) if found else np.zeros(d)
        mean = centre[places[i]] + first / max(n, 1)
        spread = np.maximum(second - first * first / max(n, 1), 0.0)
        # What rounding leaves of a constant column is no spread.
        spread[spread <= 1e-13 * np.maximum(second, n * mean * mean)] = 0.0
        std = np.sqrt(spread / max(n - 1, 1))
        if 0 < ones < n:
            start = np.zeros(d + 1)
            start[0] = math.log(ones / (n - ones))
            moving.append({"fit": i, "mean": mean, "std": std, "w": start, "try": start, "loss": math.inf, "step": None, "taken": 0})
        else:
            level = None if not n else math.inf if ones else -math.inf
            fitted[i] = Fitted(fits[i].columns, level, (0.0,) * d, tuple(mean), tuple(std), 0, True)

    while moving:
        safe = [np.where(m["std"] > 0, m["std"], 1.0) for m in moving]
        at = [m["fit"] for m in moving]
        sums = _slopes([places[i] for i in at], [without[i] for i in at], [m["mean"] for m in moving], safe, [m["try"] for m in moving])
        for m, found in zip(list(moving), _added(rows, sums, len(moving))):
            settings, size = fits[m["fit"]].settings, len(m["try"])
            penalty = np.full(size, 1.0 / settings.c)
            penalty[0] = 0.0
            loss = found[0] + 0.5 * float(penalty @ (m["try"] ** 2))
            done = False
            if loss <= m["loss"] + 1e-12 * abs(loss):
                curve = np.zeros((size, size))
                curve[np.triu_indices(size)] = found[1 + size :]
                curve = curve + np.triu(curve, 1).T + np.diag(penalty)
                push = np.array(found[1 : 1 + size]) - penalty * m["try"]
                m["w"], m["loss"], m["taken"] = m["try"], loss, m["taken"] + 1
                m["step"] = np.linalg.lstsq(curve, push, rcond=None)[0]
                small = np.abs(m["step"]).max() <= settings.tolerance * (1 + np.abs(m["w"]).max())
                done = bool(small) or m["taken"] > settings.steps
            else:
                m["step"] = m["step"] / 2
                small = done = bool(np.abs(m["step"]).max() <= 1e-15 * (1 + np.abs(m["w"]).max()))
            if done:
                w = np.where(np.concatenate([[True], m["std"] > 0]), m["w"], 0.0)
                fitted[m["fit"]] = Fitted(fits[m["fit"]].columns, float(w[0]), tuple(w[1:].tolist()), tuple(m["mean"].tolist()), tuple(m["std"].tolist()), m["taken"] - 1, bool(small))
                moving.remove(m)
            else:
                m["try"] = m["w"] + m["step"]
    return fitted


def held_out_scores(df: DataFrame, fits: Sequence[Fit], fitted: Sequence[Fitted], names: Sequence[int], label: str, fold: str) -> DataFrame:
    """(option, fold, p, y) of the held-out rows of all fits, from one pass: a row is
    scored by those fits that did not see its fold. ``names`` gives each fit's option."""
    cells = [
        F.when(
            q(fold) == f.without,
            F.struct(F.lit(o).alias("option"), F.lit(f.without).alias("fold"), m.probability().alias("p"), q(label).alias("y")),
        )
        for f, m, o in zip(fits, fitted, names)
    ]
    return df.select(F.inline(F.array_compact(F.array(*cells)))).where("p IS NOT NULL AND y IS NOT NULL")
