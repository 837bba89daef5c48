"""Joins with a side that is unique per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellclock.names import q


def lookup(df: DataFrame, answers: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``df`` with ``answers``, which is unique per key, safe for hot keys.

    The keys are packed into one struct. The answers, fresh from an aggregate on the
    same keys, are then shuffled for the join instead of keeping the aggregate's
    partitioning; only between two shuffles can adaptive execution split a hot key
    of ``df``. No hint is given: adaptive execution broadcasts the answers when their
    measured size is below the threshold and splits otherwise.
    """
    packed = answers.select(F.struct(*keys).alias("_lookup_key"), *[q(c) for c in answers.columns if c not in keys])
    return df.withColumn("_lookup_key", F.struct(*keys)).join(packed, "_lookup_key", how).drop("_lookup_key")
