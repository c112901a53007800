"""Stamps: 64-bit nanoseconds, parsed and printed exactly, never through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = r"^([+-]?)([0-9]*)(?:[.]([0-9]*))?$"


def parse_stamp(text: Column) -> Column:
    """Decimal seconds as nanoseconds; digits after the ninth are cut off. Null where the text is no such number."""
    text = F.trim(text)
    sign, whole, part = (F.regexp_extract(text, _DECIMAL, k) for k in (1, 2, 3))
    nanos = F.expr("try_multiply(cast(0 as bigint), 0)")  # typed zero
    total = F.try_add(
        F.try_multiply(F.when(whole == "", F.lit(0).cast("long")).otherwise(whole.try_cast("long")), F.lit(1_000_000_000).cast("long")),
        F.rpad(F.substring(part, 1, 9), 9, "0").try_cast("long") + nanos,
    )
    good = text.rlike(_DECIMAL) & (F.length(whole) + F.length(part) > 0)
    return F.when(good, F.when(sign == "-", -total).otherwise(total))


def format_stamp(stamp_ns: Column) -> Column:
    """``seconds.nanoseconds`` with nine digits; the seconds are rounded down, so the fraction is never negative."""
    nanos = F.pmod(stamp_ns, F.lit(1_000_000_000).cast("long"))
    seconds = F.call_function("div", stamp_ns - nanos, F.lit(1_000_000_000).cast("long"))
    return F.concat(seconds.cast("string"), F.lit("."), F.lpad(nanos.cast("string"), 9, "0"))


def stamp_of(ts: Column) -> Column:
    """Nanoseconds of a timestamp without time zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000
    inside = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000
    micros = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (day + inside + micros) * 1000


def seconds(dt_ns: Column) -> Column:
    return dt_ns * F.lit(1e-9)
