"""One pass from strikes to wide training rows.

All sources of a row — scenes, hourly values, dated rasters, static grids, labels — are
asked for in one request table of (source, slot, time, cell), made from the distinct
strikes. Scenes are asked for by blocks of BLOCK slots, so twelve offsets are three requests;
which slot a scene stands for is seen from its time after the join. Requests are known before any value is touched, so every source is pruned by
them first: by its bands, by the span of the requested times (both reach the scan), and
by a Bloom filter of the requested (time, cell) keys. Only what is left is shuffled, meets
the requests in one join, and is spread to columns by one aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellclock.functions.clock import floor_clock, shift_clock
from cellclock.names import FULL, HISTORY, HORIZONS, lag_name, q
from cellclock.operators.keyed import lookup
from cellclock.session import cut

ALWAYS = "timestamp_ntz'1970-01-01 00:00:00'"
FILTER_BITS = 1 << 26  # the largest filter: 8 MB, whatever the number of requests
BITS_A_KEY = 10
BLOCK = 6  # slots of a scene request


@dataclass(frozen=True)
class Source:
    """Values in long form and the columns wanted from them.

    ``table`` has (time, row, col, band, value), where ``time`` is ``ts`` for scenes and
    hours, ``date`` for rasters and nothing for static grids; ``band`` may be missing
    where there is only one. ``columns`` maps each output name to (band, offset);
    offsets count ``step`` minutes. ``when`` says how an offset finds its time:
    ``scene`` the slot itself, ``hour`` the hour that holds it, ``raster`` the latest
    raster on or before its day (the first one for earlier days), ``always`` no time.
    ``cell`` names the strikes' columns that hold the cell of this grid. ``default``
    replaces what the source does not hold. ``day`` names a column of the table with the
    date of ``ts``, if it has one (a partition column): days nobody asks for are not read.
    """

    table: DataFrame
    columns: Mapping[str, tuple[str | None, int]]
    when: str = "scene"
    cell: tuple[str, str] = ("row", "col")
    default: float | None = None
    day: str | None = None
    offsets: tuple[int, ...] = field(init=False)
    bands: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        if self.when not in ("scene", "hour", "raster", "always"):
            raise ValueError(f"unknown time rule: {self.when}")
        object.__setattr__(self, "offsets", tuple(sorted({k for _, k in self.columns.values()})))
        object.__setattr__(self, "bands", tuple(sorted({b for b, _ in self.columns.values() if b is not None})))


def scenes(table: DataFrame, bands: Sequence[str], offsets: Sequence[int] = HISTORY, **more) -> Source:
    return Source(table, {lag_name(b, k): (b, k) for k in offsets for b in bands}, "scene", **more)


def labels(table: DataFrame, band: str | None = None, n: int = HORIZONS, **more) -> Source:
    return Source(table, {f"lightning_{k}": (band, k) for k in range(n)}, "scene", default=0.0, **more)


def hours(table: DataFrame, variables: Sequence[str], offsets: Sequence[int] = FULL, **more) -> Source:
    """Hourly values in wide form, one column for each variable."""
    long = table.select("ts", "row", "col", F.explode(F.array(*[F.struct(F.lit(v).alias("band"), q(v).cast("double").alias("value")) for v in variables])).alias("_v"))
    return Source(long.select("ts", "row", "col", "_v.band", "_v.value"), {lag_name(v, k): (v, k) for v in variables for k in offsets}, "hour", **more)


def rasters(table: DataFrame, name: str, offsets: Sequence[int] | None = None, **more) -> Source:
    columns = {name: (None, 0)} if offsets is None else {lag_name(name, k): (None, k) for k in offsets}
    return Source(table, columns, "raster", **more)


def static(table: DataFrame, name: str = "Dem_value", **more) -> Source:
    return Source(table, {name: (None, 0)}, "always", **more)


def key_filter(keys: DataFrame, columns: Sequence[str], n: int, most: int = FILTER_BITS):
    """A Bloom filter of the ``n`` or so rows of ``keys``: a function that gives, for
    columns of another table, a condition that is true for every key that occurs.

    The filter is an array of 64-bit words in one scalar subquery. Its size follows ``n``
    up to ``most`` bits; beyond that it lets more pass, but nothing is ever lost."""
    bits = 1 << 12
    while bits < min(most, BITS_A_KEY * n):
        bits *= 2

    def places(names: Sequence[str]) -> list[Column]:
        first, second = F.xxhash64(*names), F.hash(*names).cast("long")
        return [F.pmod(h, F.lit(bits)) for h in (first, F.shiftright(first, 32) + second * 7, second)]

    set_bits = keys.select(F.explode(F.array(*places(columns))).alias("_p"))
    words = set_bits.groupBy(F.shiftright("_p", 6).cast("int").alias("_w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 as int))")).alias("_b")
    )
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("_w"), F.lit(0).cast("long").alias("_b"))
    full = words.unionByName(empty).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    held = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", "_b"))), lambda x: x["_b"]).alias("_f")).scalar()

    def may_hold(names: Sequence[str]) -> Column:
        found = [F.getbit(F.element_at(held, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(63).cast("int")) == 1 for p in places(names)]
        return found[0] & found[1] & found[2]

    return may_hold


def _times(source: Source, ts: str, step: int) -> Column:
    """Array of (slot, time) of a request: one entry for each time that is needed."""
    if source.when == "scene":
        first, last, width = min(source.offsets), max(source.offsets), BLOCK * step
        start = floor_clock(shift_clock(ts, first, step), width)
        blocks = [F.struct(F.lit(0).alias("slot"), shift_clock(start, b, width).alias("at")) for b in range(-(-(last - first) // BLOCK) + 1)]
        return F.filter(F.array(*blocks), lambda t: t["at"] <= shift_clock(ts, last, step))
    if source.when == "hour":
        # All offsets of a request fall into a few hours around it.
        first, last = (min(source.offsets) * step) // 60, (59 + max(source.offsets) * step) // 60
        hour = F.date_trunc("hour", ts).cast("timestamp_ntz")
        return F.array(*[F.struct(F.lit(h).alias("slot"), shift_clock(hour, h, 60).alias("at")) for h in range(first, last + 1)])
    if source.when == "raster":
        day = F.to_date(shift_clock(ts, min(source.offsets), step))
        return F.array(*[F.struct(F.lit(d).alias("slot"), F.date_add(day, d).cast("timestamp_ntz").alias("at")) for d in range(_days(source, step))])
    return F.array(F.struct(F.lit(0).alias("slot"), F.expr(ALWAYS).alias("at")))


def _days(source: Source, step: int) -> int:
    return (max(source.offsets) - min(source.offsets)) * step // 1440 + 2


def _slot(source: Source, k: int, ts: Column, step: int) -> Column:
    """The slot in which the value of offset ``k`` was asked for."""
    if source.when == "scene":
        return F.lit(k)
    if source.when == "hour":
        return F.floor((F.minute(ts) + k * step) / 60).cast("int")
    if source.when == "raster":
        return F.datediff(F.to_date(shift_clock(ts, k, step)), F.to_date(shift_clock(ts, min(source.offsets), step)))
    return F.lit(0)


def _dated(asked: DataFrame, source: Source, number: int) -> DataFrame:
    """Requested days of a raster source become the dates of the rasters to read.

    Days and raster dates are bounded by the time span, so the range join runs between
    two calendars and its result is small enough to be sent to all tasks."""
    own = asked.where(F.col("source") == number)
    timeline = Window.orderBy("date")
    dates = source.table.select("date").distinct()
    spans = dates.select(
        F.when(F.row_number().over(timeline) == 1, F.to_date(F.lit("0001-01-01"))).otherwise(F.col("date")).alias("_lo"),
        F.coalesce(F.lead("date").over(timeline), F.to_date(F.lit("9999-12-31"))).alias("_hi"),
        F.col("date").cast("timestamp_ntz").alias("_raster"),
    )
    days = own.select(F.to_date("at").alias("_day")).distinct()
    calendar = days.join(F.broadcast(spans), (F.col("_day") >= F.col("_lo")) & (F.col("_day") < F.col("_hi"))).select("_day", "_raster")
    return own.withColumn("_day", F.to_date("at")).join(F.broadcast(calendar), "_day").select(*[F.col("_raster").alias("at") if c == "at" else c for c in asked.columns])


def requests(df: DataFrame, sources: Sequence[Source], ts: str = "ts", step: int = 10) -> tuple[DataFrame, list[str]]:
    """(request table, key columns): every (source, slot, at, row, col) that a distinct
    strike needs, beside the strike's key."""
    keys = [ts, *dict.fromkeys(c for s in sources for c in s.cell)]

    def part(i: int, s: Source) -> Column:
        row, col = (q(c).cast("int") for c in s.cell)
        entry = lambda t: F.struct(F.lit(i).alias("source"), t["slot"].alias("slot"), t["at"].alias("at"), row.alias("row"), col.alias("col"))
        return F.transform(_times(s, ts, step), entry)

    named = df.select(*[q(c).alias(f"_key_{n}") for n, c in enumerate(keys)], *[q(c) for c in keys]).distinct()
    asked = named.select(*[f"_key_{n}" for n in range(len(keys))], F.explode(F.concat(*[part(i, s) for i, s in enumerate(sources)])).alias("_a")).select("*", "_a.*").drop("_a")
    dated = [i for i, s in enumerate(sources) if s.when == "raster"]
    if dated:
        rest = asked.where(~F.col("source").isin(dated))
        for i in dated:
            rest = rest.unionByName(_dated(asked, sources[i], i))
        asked = rest
    return asked, keys


def _merged(sources: Sequence[Source]) -> tuple[list[Source], list[int]]:
    """Sources that ask one table in one way become one; and which of them each is now."""
    reads, place = {}, []
    for s in sources:
        key = (id(s.table), s.when, s.cell, s.day)
        place.append(list(reads).index(key) if key in reads else len(reads))
        reads.setdefault(key, []).append(s)
    merged = [Source(g[0].table, {f"{i}/{n}": c for i, s in enumerate(g) for n, c in s.columns.items()}, g[0].when, g[0].cell, None, g[0].day) for g in reads.values()]
    return merged, place


def pruned(source: Source, asked: DataFrame, number: int, span, keys: int, step: int = 10) -> DataFrame:
    """(source, at, row, col, band, value, time) of what ``asked`` may want from a source.

    ``span`` is the first and last time that is asked for. Nothing is aggregated here:
    bands and times are conditions on columns of the table, so they reach its scan. With so
    many keys that a Bloom filter would let most pass, none is made."""
    table = source.table
    if source.bands and all(b is not None for b, _ in source.columns.values()):
        table = table.where(F.col("band").isin(*source.bands))
    time = F.lit(None).cast("timestamp_ntz")
    if source.when == "scene":
        span = (span[0], span[1] + timedelta(minutes=BLOCK * step))
    if source.when in ("scene", "hour"):
        table = table.where(F.col("ts").between(F.lit(span[0]).cast("timestamp_ntz"), F.lit(span[1]).cast("timestamp_ntz")))
        if source.day:
            table = table.where(F.col(source.day).between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")))
        at = F.col("ts")
        if source.when == "scene":
            at, time = floor_clock("ts", BLOCK * step), F.col("ts").cast("timestamp_ntz")
    elif source.when == "raster":
        table = table.where(F.col("date").between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")))
        at = F.col("date").cast("timestamp_ntz")
    else:
        at = F.expr(ALWAYS)
    band = F.col("band") if source.bands else F.lit(None).cast("string")
    facts = table.select(at.alias("at"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), band.alias("band"), F.col("value").cast("double").alias("value"), time.alias("time"))
    if 2 * keys > FILTER_BITS:
        return facts.select(F.lit(number).alias("source"), "*")
    may_hold = key_filter(asked.where(F.col("source") == number), ["at", "row", "col"], keys)
    return facts.where(may_hold(["at", "row", "col"])).select(F.lit(number).alias("source"), "*")


def assemble(df: DataFrame, sources: Sequence[Source], ts: str = "ts", step: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the columns of all sources, in their order.

    A key with several values has their largest; a value that is absent is the source's
    default or NULL. Rows of ``df`` are kept as they are; strikes without a time or cell
    find nothing. The request table is written once to the shared folder. ``columns`` are
    those wanted of the sources, all by default; what only others need is not looked up."""
    if columns is not None:
        held = [{n: c for n, c in s.columns.items() if n in columns} for s in sources]
        sources = [Source(s.table, c, s.when, s.cell, s.default, s.day) for s, c in zip(sources, held) if c]
    reads, place = _merged(sources)
    asked, keys = requests(df, reads, ts, step)
    asked = cut(asked)
    found = asked.groupBy("source").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.approx_count_distinct(F.xxhash64("at", "row", "col")).alias("n")).collect()
    spans = {r["source"]: r for r in found}  # one row for each source
    facts = None
    for i, s in enumerate(reads):
        if i in spans and spans[i]["a"] is not None:
            part = pruned(s, asked, i, (spans[i]["a"], spans[i]["b"]), spans[i]["n"], step)
            facts = part if facts is None else facts.unionByName(part)
    packed = [f"_key_{n}" for n in range(len(keys))]
    wanted = {name: (i, s, band, k) for i, s in zip(place, sources) for name, (band, k) in s.columns.items()}
    cells = {}  # (source, band, slot) -> column of the aggregate
    for i, s in enumerate(reads):
        if s.when == "scene":
            for band, k in dict.fromkeys(s.columns.values()):
                cells[i, band, k] = f"_v{len(cells)}"
            continue
        slots = {"hour": range((min(s.offsets) * step) // 60, (59 + max(s.offsets) * step) // 60 + 1), "raster": range(_days(s, step)), "always": (0,)}[s.when]
        for band in dict.fromkeys(b for b, _ in s.columns.values()):
            for slot in slots:
                cells[i, band, slot] = f"_v{len(cells)}"
    if facts is None:
        nothing = F.lit(None).cast("double")
        return df.withColumns({name: F.coalesce(nothing, F.lit(s.default).cast("double")) for name, (_, s, _, _) in wanted.items()})

    def cell(i: int, band: str | None, slot: int) -> Column:
        return (F.col("source") == i) & (F.col("slot") == slot) & (F.lit(True) if band is None else F.col("band") == band)

    joined = asked.join(facts, ["source", "at", "row", "col"])
    scene = [i for i, s in enumerate(reads) if s.when == "scene"]
    if scene:
        # Only what stands exactly on a slot of the strike counts.
        apart = F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.col("_key_0").cast("timestamp"))
        exact = F.when(apart % (step * 60_000_000) == 0, F.floor(apart / (step * 60_000_000)).cast("int"))
        offsets = sorted({k for i in scene for k in reads[i].offsets})
        joined = joined.withColumn("slot", F.when(F.col("source").isin(scene), exact).otherwise(F.col("slot")))
        joined = joined.where(~F.col("source").isin(scene) | F.col("slot").between(offsets[0], offsets[-1]))
    vectors = joined.groupBy(*packed).agg(*[F.max(F.when(cell(*c), F.col("value"))).alias(name) for c, name in cells.items()])
    vectors = vectors.select(*[F.col(p).alias(k) for p, k in zip(packed, keys)], *cells.values())
    out = lookup(df, vectors, keys)

    def value(i: int, s: Source, band: str | None, k: int) -> Column:
        # Hours and rasters count their slots from the first offset of the merged source.
        own, s = s, reads[i]
        if s.when in ("scene", "always"):
            picked = F.col(cells[i, band, k if s.when == "scene" else 0])
        else:
            slot = _slot(s, k, q(ts), step)
            picked = F.coalesce(*[F.when(slot == j, F.col(name)) for (n, b, j), name in cells.items() if (n, b) == (i, band)])
        return picked if own.default is None else F.coalesce(picked, F.lit(own.default).cast("double"))

    return out.withColumns({name: value(*spec) for name, spec in wanted.items()}).drop(*cells.values())
