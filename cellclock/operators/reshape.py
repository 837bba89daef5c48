"""Training and evaluation rows from wide lag samples. All narrow: one explode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellclock.functions.cleaning import drop_missing
from cellclock.names import HORIZONS, lag_columns, lag_name, q


def horizon_slices(
    df: DataFrame,
    bands: Sequence[str],
    key: Sequence[str],
    static: Sequence[str] = (),
    horizons: int = HORIZONS,
    label: str = "output_",
) -> DataFrame:
    """One row per sample and horizon h: lags [h-n, h) renamed to t-n..t-1, the
    static bands repeated, and the label of that horizon as ``label``."""
    rows = []
    for h in range(horizons):
        fields = [f"{h} AS horizon"]
        fields += [
            f"`{lag_name(b, k + h)}` AS `{lag_name(b, k)}`" for b in bands if b not in static for k in range(-horizons, 0)
        ]
        fields += [f"`{b}`" for b in bands if b in static]
        rows.append(f"struct({', '.join(fields)}, `{label}{h}` AS label)")
    return df.select(*key, F.expr(f"inline(array({', '.join(rows)}))"))


def sliding_training_rows(
    df: DataFrame,
    bands: Sequence[str],
    key: Sequence[str],
    static: Sequence[str] = (),
    horizons: int = HORIZONS,
) -> DataFrame:
    """The slices as one training table: six rows per sample, label ``output_0``."""
    return horizon_slices(df, bands, key, static, horizons).drop("horizon").withColumnRenamed("label", "output_0")


def multi_output_rows(
    df: DataFrame,
    bands: Sequence[str],
    key: Sequence[str],
    horizons: int = HORIZONS,
    amounts: bool = False,
) -> DataFrame:
    """Direct form: a sequence ``[step][band]`` of the history and all labels (and
    amounts) at once. Rows with any missing feature are dropped."""
    history = range(-horizons, 0)
    clean = drop_missing(df, lag_columns(bands, history))
    sequence = F.array(*[F.array(*[q(lag_name(b, k)).cast("double") for b in bands]) for k in history])
    out = [
        sequence.alias("sequence"),
        F.array(*[q(f"output_{i}").cast("int") for i in range(horizons)]).alias("labels"),
    ]
    if amounts:
        out.append(F.array(*[q(f"lightning_{i}").cast("double") for i in range(horizons)]).alias("amounts"))
    return clean.select(*key, *out)


def assemble_sequence(
    df: DataFrame,
    bands: Sequence[str],
    offsets: Sequence[int],
    static: Sequence[str] = (),
    output: str = "features",
    handle_invalid: str = "skip",
) -> DataFrame:
    """Time-major feature vector of the lags; incomplete rows are skipped."""
    names = lag_columns(bands, offsets, static, time_major=True)
    return VectorAssembler(inputCols=names, outputCol=output, handleInvalid=handle_invalid).transform(df)


def features_and_labels(df: DataFrame, key: Sequence[str], features: Sequence[str], labels: Sequence[str]):
    """(X, y) as two tables that share ``key``; row order is no key."""
    return df.select(*key, *[q(c) for c in features]), df.select(*key, *[q(c) for c in labels])
