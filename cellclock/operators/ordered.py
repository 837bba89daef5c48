"""Work that needs a global order without a global window.

A window without ``partitionBy`` puts the whole table into one task. Here the
table is range-partitioned once, each partition is summarised, and the summaries
(one row per partition and group) carry the offset into it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellclock.names import q
from cellclock.operators.keyed import lookup
from cellclock.session import cut


def _sorted(columns: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]


def running_total(
    df: DataFrame,
    order_by: Sequence[str],
    values: Mapping[str, str],
    partition_by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Inclusive cumulative sums: ``values`` maps new column -> summed column.

    Rows must be unique in ``partition_by + order_by`` (aggregate first), which is
    also what keeps one hot value from filling a range.
    """
    group = list(partition_by)
    keys = [F.col(c) for c in group] + _sorted(order_by, descending)
    # The partition number is only stable once written: the range bounds come from
    # sampling and may differ when the plan is run again.
    placed = cut(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(*group, "_range").agg(*[F.sum(q(v)).alias(f"_sum_{n}") for n, v in values.items()])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group,
        "_range",
        *[F.coalesce(F.sum(q(f"_sum_{n}")).over(before), F.lit(0)).alias(f"_before_{n}") for n in values],
    )
    local = (
        Window.partitionBy(*group, "_range")
        .orderBy(*_sorted(order_by, descending))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = lookup(placed, offsets, [*group, "_range"], "inner")
    return out.withColumns(
        {n: F.sum(q(v)).over(local) + q(f"_before_{n}") for n, v in values.items()}
    ).drop("_range", *[f"_before_{n}" for n in values])


def number_rows(
    df: DataFrame, order_by: Sequence[str], name: str = "rn", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Consecutive numbers from 1 in the order of unique ``order_by``, restarting
    per group of ``partition_by``. One range shuffle, whatever the group sizes."""
    group = list(partition_by)
    keys = [F.col(c).asc() for c in [*group, *order_by]]
    placed = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    placed = placed.withColumns(
        {"_range": F.shiftright("_mid", 33), "_pos": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    # Rows of one group are contiguous in a range: first position and count suffice.
    sums = placed.groupBy(*group, "_range").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_add")
    )
    return (
        lookup(placed, offsets, [*group, "_range"], "inner")
        .withColumn(name, F.col("_pos") + F.col("_add"))
        .drop("_mid", "_range", "_pos", "_add")
    )


def batch_numbers(
    df: DataFrame, order_by: Sequence[str], size: int, name: str = "batch", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Batch 0 holds the first ``size`` rows in order, and so on."""
    numbered = number_rows(df, order_by, "_rn", partition_by)
    return numbered.withColumn(name, F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def value_ranks(df: DataFrame, value: str, group_by: Sequence[str] = (), weight: str | None = None) -> tuple[DataFrame, list[str]]:
    """The stored relation of distinct values that profiles are made from, and its group
    columns: ``_v`` with its count ``_c``, the count up to it ``_end``, and of its group
    the total ``_n`` and the mean ``_mean``.

    ``df`` is scanned once, here: equal values are counted before any shuffle and sorted
    in ranges, which are written. Whatever is aggregated from the relation reads that
    table. NULL and NaN are left out, values count as doubles; a ``weight`` counts a row
    several times, or not at all.
    """
    group = list(group_by) or ["_all"]
    w = q(weight) if weight else F.lit(1)
    clean = df.where(q(value).isNotNull() & ~F.isnan(q(value).cast("double")))
    if not group_by:
        clean = clean.withColumn("_all", F.lit(0))
    counts = clean.groupBy(*[q(g) for g in group], q(value).cast("double").alias("_v")).agg(
        F.sum(w).cast("long").alias("_c")
    )
    counts = counts.where(F.col("_c") > 0)
    ranked = running_total(counts, ["_v"], {"_end": "_c"}, group)
    totals = ranked.groupBy(*group).agg(
        F.max("_end").alias("_n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("_mean")
    )
    return lookup(ranked, totals, group, "inner"), group


def rank_moments() -> dict[str, Column]:
    """count, mean, std (of the sample), min and max as aggregates over ``value_ranks``.
    The mean is known by then, so deviations do not cancel."""
    n, gap = F.max("_n"), F.col("_v") - F.col("_mean")
    return {
        "count": n,
        "mean": F.max("_mean"),
        "std": F.when(n > 1, F.sqrt(F.sum(F.col("_c") * gap * gap) / F.nullif(n - 1, F.lit(0)))),
        "min": F.min("_v"),
        "max": F.max("_v"),
    }


def rank_quantiles(
    ranks: DataFrame, group: Sequence[str], probs: Mapping[str, float], also: Mapping[str, Column] | None = None
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value_ranks``, with further aggregates
    ``also`` over the same rows. Only the rows that hold a wanted rank are combined at the
    end, so no task sees a whole group."""

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")), F.col("_v")))

    also = also or {}
    aggs = [F.max("_n").alias("_total"), *[c.alias(n) for n, c in also.items()]]
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_n") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
    picked = ranks.groupBy(*group).agg(*aggs)
    exprs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        lo, hi = q(f"_lo_{name}"), q(f"_hi_{name}")
        exprs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*group, *also, *exprs)


def quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    group_by: Sequence[str] = (),
    weight: str | None = None,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``rank_quantiles`` of the ``value_ranks`` of ``df``: one scan of it."""
    ranks, group = value_ranks(df, value, group_by, weight)
    out = rank_quantiles(ranks, group, probs, also)
    return out if group_by else out.drop(*group)


def top_k(df: DataFrame, score: str, k: int, ties: Sequence[str], descending: bool = True) -> DataFrame:
    """The k best rows; ``ties`` makes the choice unique."""
    first = F.col(score).desc() if descending else F.col(score).asc()
    return df.orderBy(first, *ties).limit(k)


def sort_output(df: DataFrame, *columns: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*_sorted(columns, descending))


def best_step(
    history: DataFrame, step: str = "step", score: str = "score", group_by: Sequence[str] = ()
) -> DataFrame:
    """The row of the maximum score, the earliest step on a tie."""
    rest = [c for c in history.columns if c not in group_by]
    order = F.struct(F.col(score), -F.col(step))
    best = history.groupBy(*group_by).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*group_by, "_best.*")


def early_stop_point(
    history: DataFrame,
    run: str,
    epoch: str = "epoch",
    score: str = "score",
    patience: int = 5,
    tolerance: float = 1e-8,
) -> DataFrame:
    """Per run: the best epoch when training stops, and where it stops.

    A run's history is one row per epoch, tens to thousands; it is folded in epoch
    order. An epoch only counts as better by more than ``tolerance``.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(score).alias("s"))))
    start = F.struct(
        F.lit(None).cast("long").alias("best_epoch"),
        F.lit(float("-inf")).alias("best_score"),
        F.lit(0).alias("waited"),
        F.lit(None).cast("long").alias("stop_epoch"),
    )

    def fold(acc: Column, x: Column) -> Column:
        better = x["s"].cast("double") > acc["best_score"] + F.lit(tolerance)
        waited = F.when(better, 0).otherwise(acc["waited"] + 1)
        moved = F.struct(
            F.when(better, x["e"].cast("long")).otherwise(acc["best_epoch"]).alias("best_epoch"),
            F.when(better, x["s"].cast("double")).otherwise(acc["best_score"]).alias("best_score"),
            waited.alias("waited"),
            F.when(waited >= patience, x["e"].cast("long")).alias("stop_epoch"),
        )
        return F.when(acc["stop_epoch"].isNotNull(), acc).otherwise(moved)

    folded = history.groupBy(run).agg(F.aggregate(steps, start, fold).alias("_f"))
    return folded.select(run, "_f.best_epoch", "_f.best_score", "_f.stop_epoch")
