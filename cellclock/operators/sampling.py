"""Sampling, splitting and set operations, repeatable because every choice is
made by a hash of the row's key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellclock.names import q
from cellclock.operators.keyed import lookup
from cellclock.operators.ordered import number_rows, running_total

_PRIME = 2147483647
_BUCKET_BITS = 15  # 31-bit hashes in 65536 buckets


def row_hash(key: Sequence[str], seed: int = 42, kind: str = "xxhash64") -> Column:
    """A number in [0, 2^31) per key. ``arithmetic`` takes one integer key and uses
    only integer arithmetic, for comparison with other engines."""
    if kind == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(*[q(k) for k in key], F.lit(seed)), 33)
    if kind == "arithmetic":
        (k,) = key
        once = F.pmod(F.pmod(q(k).cast("long"), F.lit(_PRIME)) * 48271 + seed, F.lit(_PRIME))
        return F.pmod(once * 69621 + 12345, F.lit(_PRIME))
    raise ValueError(f"unknown hash: {kind}")


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = 42, kind: str = "xxhash64") -> DataFrame:
    """A full permutation: global sort by hash (a range shuffle)."""
    return df.withColumn("_h", row_hash(key, seed, kind)).orderBy("_h", *key).drop("_h")


def sample_by_quota(
    df: DataFrame,
    quotas: DataFrame,
    group_by: Sequence[str],
    key: Sequence[str],
    seed: int = 42,
    kind: str = "xxhash64",
) -> DataFrame:
    """Per group exactly ``quota`` rows, those of the smallest hashes.

    Hash buckets are counted; buckets below the one where the quota is reached are
    kept without any shuffle, and only that one bucket (1/65536 of the group) is
    ranked.
    """
    group = list(group_by)
    hashed = df.withColumn("_h", row_hash(key, seed, kind))
    hashed = hashed.withColumn("_b", F.shiftright("_h", _BUCKET_BITS).cast("int"))
    counts = hashed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    counts = lookup(counts, quotas, group, "inner")
    # One row per group: the last bucket needed and what is still wanted from it.
    edge = (
        counts.where(F.col("_before") < F.col("quota"))
        .groupBy(*group)
        .agg(F.max(F.struct("_b", (F.col("quota") - F.col("_before")).alias("_left"))).alias("_e"))
        .select(*group, F.col("_e._b").alias("_edge"), F.col("_e._left").alias("_left"))
    )
    near = lookup(hashed, edge, group, "inner")
    whole = near.where(F.col("_b") < F.col("_edge"))
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", *key))
    partial = near.where(F.col("_b") == F.col("_edge")).withColumn("_r", rank).where(F.col("_r") <= F.col("_left"))
    columns = [q(c) for c in df.columns]
    return whole.select(*columns).unionByName(partial.select(*columns))


def sample_n(
    df: DataFrame, n: int, key: Sequence[str], seed: int = 42, kind: str = "xxhash64", strict: bool = True
) -> DataFrame:
    """Exactly ``n`` rows; with ``strict`` the query fails when there are fewer."""
    one = df.withColumn("_all", F.lit(0))
    have = one.groupBy("_all").agg(F.count(F.lit(1)).alias("_n"))
    quota = F.lit(n)
    if strict:
        short = F.raise_error(F.format_string(f"not enough rows: %d < {n}", F.col("_n")))
        quota = F.when(F.col("_n") < n, short.cast("int")).otherwise(quota)
    return sample_by_quota(one, have.select("_all", quota.alias("quota")), ["_all"], key, seed, kind).drop("_all")


def ratio_merge(
    positives: DataFrame,
    negatives: DataFrame,
    scale: float,
    max_positives: int,
    file: str = "file",
    key: str = "key",
    block: int = 100_000,
) -> DataFrame:
    """Positives of each file in parts of at most ``max_positives``; each part, in
    order of (file, key), takes the next ``int(len * scale)`` negatives of one
    global stream ordered by (file, key). No negative is used twice; the last
    parts get fewer when the stream ends. Adds ``part``.

    Both sides are numbered by range partition. The parts' intervals meet the
    numbered negatives in blocks of ``block`` positions, where a running "last
    interval seen" assigns each negative once, so no pairs are formed.
    """
    if scale <= 0 or max_positives <= 0:
        raise ValueError("scale and max_positives must be positive")
    pos = number_rows(positives, [key], "_rn", [file])
    pos = pos.withColumn("_chunk", F.floor((F.col("_rn") - 1) / max_positives)).drop("_rn")
    parts = pos.groupBy(file, "_chunk").agg(
        F.floor(F.count(F.lit(1)) * F.lit(float(scale))).alias("_need"), F.lit(1).alias("_one")
    )
    parts = running_total(parts, [file, "_chunk"], {"_hi": "_need", "_part": "_one"})
    parts = parts.select(
        file, "_chunk", (F.col("_part") - 1).alias("part"), (F.col("_hi") - F.col("_need")).alias("_lo"), "_hi"
    )
    taken = lookup(pos, parts.select(file, "_chunk", "part"), [file, "_chunk"], "inner").drop("_chunk")

    neg = number_rows(negatives, [file, key], "_at")
    columns = negatives.columns
    rows = neg.select(
        F.floor((F.col("_at") - 1) / block).alias("_block"),
        "_at",
        F.lit(1).alias("_is_row"),
        F.lit(None).cast("struct<part:bigint,hi:bigint>").alias("_mark"),
        F.struct(*[q(c) for c in columns]).alias("_row"),
    )
    starts = parts.where("_hi > _lo").select(
        F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block))).alias("_block"),
        "part", "_lo", "_hi",
    )
    marks = starts.select(
        "_block",
        (F.greatest(F.col("_lo"), F.col("_block") * block) + 1).alias("_at"),
        F.lit(0).alias("_is_row"),
        F.struct(F.col("part").cast("long").alias("part"), F.col("_hi").cast("long").alias("hi")).alias("_mark"),
        F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
    )
    w = Window.partitionBy("_block").orderBy("_at", "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    assigned = rows.unionByName(marks).withColumn("_mark", F.last("_mark", True).over(w))
    assigned = assigned.where((F.col("_is_row") == 1) & (F.col("_at") <= F.col("_mark.hi")))
    used = assigned.select("_row.*", F.col("_mark.part").alias("part"))
    return union_relaxed(taken, used)


def validation_merge(
    positives: DataFrame,
    negatives: DataFrame,
    n: int,
    scale: float,
    file: str = "file",
    key: Sequence[str] = ("key",),
    seed: int = 42,
    kind: str = "xxhash64",
) -> DataFrame:
    """Exactly ``n`` positives and ``int(n * scale)`` negatives: whole files in name
    order, the last one sampled down to what is still needed."""
    chosen = sample_n(positives, n, key, seed, kind)
    need = int(n * scale)
    files = negatives.groupBy(file).agg(F.count(F.lit(1)).alias("_n"))
    files = running_total(files, [file], {"_end": "_n"})
    left = F.lit(need) - (F.col("_end") - F.col("_n"))
    quotas = files.select(file, F.greatest(F.lit(0), F.least(F.col("_n"), left)).alias("quota")).where("quota > 0")
    return union_relaxed(chosen, sample_by_quota(negatives, quotas, [file], key, seed, kind))


def train_val_split(
    df: DataFrame, key: Sequence[str], train_percent: int = 80, seed: int = 42, kind: str = "xxhash64"
) -> tuple[DataFrame, DataFrame]:
    h = F.pmod(row_hash(key, seed, kind), F.lit(100))
    return df.where(h < train_percent), df.where(h >= train_percent)


def stratified_folds(
    df: DataFrame,
    key: Sequence[str],
    label: str | None = None,
    folds: int = 5,
    seed: int = 42,
    kind: str = "xxhash64",
    name: str = "fold",
) -> DataFrame:
    """Fold number per row. By hash alone each label is spread evenly in
    expectation, without a shuffle; with ``label`` the counts of a label differ by
    at most one between folds."""
    h = row_hash(key, seed, kind)
    if label is None:
        return df.withColumn(name, F.pmod(h, F.lit(folds)).cast("int"))
    numbered = number_rows(df.withColumn("_h", h), ["_h", *key], "_rn", [label])
    return numbered.withColumn(name, F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")).drop("_h", "_rn")


def random_time_buckets(
    slots: DataFrame, n: int, months: Sequence[int] | None = (5, 6, 7), seed: int = 42, kind: str = "xxhash64"
) -> DataFrame:
    """``n`` random slots of the given months. ``slots``: ts, slot (integer)."""
    kept = slots if months is None else slots.where(F.month("ts").isin(*months))
    return sample_n(kept, n, ["slot"], seed, kind)


def union_rows(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def union_relaxed(*tables: DataFrame) -> DataFrame:
    """Columns that one side lacks become NULL; types are widened by the union."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def union_filtered(first: DataFrame, second: DataFrame, label: str = "output_0") -> DataFrame:
    """All rows of ``first`` and the negatives of ``second``."""
    return first.unionByName(second.where(q(label) == 0), allowMissingColumns=True)
