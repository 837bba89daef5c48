"""Lag columns from a long series on the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellclock.functions.clock import slot_number
from cellclock.names import FULL, lag_name, q


def lag_features(
    series: DataFrame,
    bands: Sequence[str],
    offsets: Sequence[int] = FULL,
    step: int = 10,
    ts: str = "ts",
    cell: Sequence[str] = ("row", "col"),
    chunk: int = 144,
) -> DataFrame:
    """``BAND_t±k``: the band k slots away at the same cell, NULL when there is no
    row for that slot. ``series`` is unique per (cell, slot).

    The series of a cell is cut into chunks of ``chunk`` slots. Rows near a border
    are also sent to the neighbour chunk, so a window never spans more than one
    chunk, however long the history of one cell is, and only the border rows are
    shuffled twice.
    """
    reach_back, reach_on = -min([*offsets, 0]), max([*offsets, 0])
    if max(reach_back, reach_on) > chunk:
        raise ValueError("offsets must not reach beyond one chunk")
    slot = slot_number(ts, step)
    base = series.withColumn("_slot", slot).withColumn("_own", F.floor(F.col("_slot") / chunk))
    pos = F.pmod(F.col("_slot"), F.lit(chunk))
    chunks = F.array_compact(
        F.array(
            F.col("_own"),
            F.when(pos >= chunk - reach_back, F.col("_own") + 1),
            F.when(pos < reach_on, F.col("_own") - 1),
        )
    )
    spread = base.withColumn("_chunk", F.explode(chunks))
    part = Window.partitionBy(*cell, "_chunk").orderBy("_slot")
    frame = part.rangeBetween(-reach_back, reach_on)
    # At most len(offsets) neighbours fall into the frame.
    near = F.map_from_entries(
        F.collect_list(F.struct(F.col("_slot"), F.struct(*[q(b) for b in bands]))).over(frame)
    )
    seen = spread.withColumn("_near", near).where(F.col("_chunk") == F.col("_own"))
    cols = {lag_name(b, k): F.expr(f"try_element_at(_near, _slot + {k}).`{b}`") for b in bands for k in offsets}
    return seen.withColumns(cols).drop("_slot", "_own", "_chunk", "_near")
