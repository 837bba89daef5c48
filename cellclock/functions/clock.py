"""Column functions on the scene clock. All return timestamps without zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ntz(x: Column) -> Column:
    return x.cast("timestamp_ntz")


def ts_from_parts(year, month, day, hour, minute, second=None) -> Column:
    second = F.lit(0) if second is None else _c(second)
    return F.make_timestamp_ntz(_c(year), _c(month), _c(day), _c(hour), _c(minute), second)


def epoch_minutes(ts: Column | str) -> Column:
    """Whole minutes since 1970; seconds are dropped."""
    return F.floor(F.unix_seconds(_c(ts).cast("timestamp")) / 60).cast("long")


def from_epoch_minutes(minutes: Column) -> Column:
    return _ntz(F.timestamp_seconds(minutes * 60))


def ceil_clock(ts: Column | str, step: int = 10) -> Column:
    """Up to the next multiple of ``step`` minutes. Seconds are dropped first, so
    00:10:45 stays in slot 00:10 and exact multiples do not move."""
    m = epoch_minutes(ts)
    return from_epoch_minutes(m + F.pmod(-m, F.lit(step)))


def floor_clock(ts: Column | str, step: int = 10) -> Column:
    m = epoch_minutes(ts)
    return from_epoch_minutes(m - F.pmod(m, F.lit(step)))


def floor_hour(ts: Column | str) -> Column:
    return _ntz(F.date_trunc("hour", _c(ts)))


def shift_clock(ts: Column | str, k: Column | int, step: int = 10) -> Column:
    """``k`` steps later (earlier when negative)."""
    k = F.lit(k) if isinstance(k, int) else k
    return _c(ts) + F.make_dt_interval(mins=(k * step).cast("int"))


def slot_number(ts: Column | str, step: int = 10) -> Column:
    """Integer index of the slot that starts at ``ts``."""
    m = epoch_minutes(ts)
    return ((m - F.pmod(m, F.lit(step))) / step).cast("long")


def slot_time(slot: Column | str, step: int = 10) -> Column:
    return from_epoch_minutes(_c(slot) * step)


def format_slot(ts: Column | str, style: str = "dash") -> Column:
    """``dash`` 2020-05-01-00-10, ``day`` 20200501, ``report`` 2020/5/1:0h10."""
    ts = _c(ts)
    if style == "dash":
        return F.date_format(ts, "yyyy-MM-dd-HH-mm")
    if style == "day":
        return F.date_format(ts, "yyyyMMdd")
    if style == "report":
        return F.format_string(
            "%d/%d/%d:%dh%d", F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts)
        )
    raise ValueError(f"unknown style: {style}")


_FIVE_NUMBERS = r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})[-/:](\d{1,2})[-/h](\d{1,2})"
_COMPACT = r"s(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})"


def parse_slot(text: Column | str, style: str = "any") -> Column:
    """Read the three list notations (``any``) or ``…sYYYYMMDDhhmm…`` (``compact``).
    Text that does not match gives NULL."""
    text = _c(text)
    pattern = _COMPACT if style == "compact" else _FIVE_NUMBERS
    part = [F.regexp_extract(text, pattern, i).try_cast("int") for i in range(1, 6)]
    return F.try_make_timestamp_ntz(*part, F.lit(0))
