"""Casting, finiteness, time and hashing expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

INF = float("inf")

# Accepted spellings of an event time, tried in this order.
TIME_FORMATS = (
    "dd/MM/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
)

# Protocol numbers with a name.
PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP"}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: str | Column) -> Column:
    """Double, or null where the text is no number (plain casts raise under ANSI)."""
    return col(c).try_cast("double")


def finite(c: str | Column) -> Column:
    """The value, or null when it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & ~c.isin(INF, -INF), c)


def finite_or(c: str | Column, fill: float) -> Column:
    return F.coalesce(finite(to_double(c)), F.lit(float(fill)))


def to_int(c: str | Column) -> Column:
    """Whole part of a number given as number or text; null otherwise."""
    return finite(to_double(c)).try_cast("int")


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch; accepts TIMESTAMP and TIMESTAMP_NTZ."""
    return F.unix_micros(col(c).cast("timestamp"))


def first_present(df, names) -> Column:
    """First non-null among the columns of `names` that `df` has."""
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def parse_event_time(c: str | Column, fmt: str = TIME_FORMATS[0]) -> Column:
    return F.try_to_timestamp(F.trim(col(c)), F.lit(fmt))


def parse_event_time_multi(c: str | Column, formats=TIME_FORMATS) -> Column:
    """First of several formats that parses. Fraction digits of any length are accepted."""
    text = F.trim(col(c).cast("string"))
    tries = []
    for fmt in formats:
        if fmt.endswith(".SSSSSS"):
            whole = F.try_to_timestamp(F.regexp_replace(text, r"\.\d{1,6}$", ""), F.lit(fmt[:-7]))
            part = F.rpad(F.regexp_extract(text, r"\.(\d{1,6})$", 1), 6, "0")
            full = F.timestamp_micros(F.unix_micros(whole) + part.try_cast("long"))
            tries.append(F.when(text.rlike(r"\.\d{1,6}$"), full))
        else:
            tries.append(F.try_to_timestamp(text, F.lit(fmt)))
    return F.coalesce(*tries)


def temporal(ts: str | Column, default: int | None = None) -> dict[str, Column]:
    """Hour, DayOfWeek (Sunday = 1) and IsWeekend of an event time."""
    ts = col(ts)
    day = F.dayofweek(ts)
    parts = {
        "Hour": F.hour(ts),
        "DayOfWeek": day,
        "IsWeekend": F.when(day.isin(1, 7), 1).otherwise(0),
    }
    if default is not None:
        parts = {k: F.coalesce(v, F.lit(default)) for k, v in parts.items()}
    return parts


def protocol_name(c: str | Column) -> Column:
    """Name for a protocol number; names pass through; anything else is Unknown."""
    text = F.upper(F.trim(col(c).cast("string")))
    number = to_int(c)
    named = reduce(
        lambda acc, kv: acc.when(number == kv[0], kv[1]),
        list(PROTOCOL_NAMES.items())[1:],
        F.when(number == 1, PROTOCOL_NAMES[1]),
    )
    return (
        F.when(text.isin(*PROTOCOL_NAMES.values()), text)
        .when(number.isNotNull(), named.otherwise("Other"))
        .otherwise("Unknown")
    )


def confidence_fraction(c: str | Column) -> Column:
    """Confidence on a 0-1 scale: values above 1 are percents, null is 0."""
    c = F.coalesce(to_double(c), F.lit(0.0))
    return F.when(c > 1, c / 100).otherwise(c)


def hash_32(*cols: str | Column, seed: int = 42) -> Column:
    """32-bit number from md5 of the key: the same row gets the same number on every
    run, partition layout and engine, which rand() does not offer."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_unit(*cols: str | Column, seed: int = 42) -> Column:
    """Uniform number in [0, 1) from `hash_32`."""
    return hash_32(*cols, seed=seed) / F.lit(4294967296.0)
