"""Timestamps of raw bars: epoch units, local times of zones with daylight saving, labels of minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By the least median magnitude: unit of an epoch and how many make a second.
UNITS = [(1e17, "ns", 1_000_000_000), (1e14, "us", 1_000_000), (1e11, "ms", 1_000), (0.0, "s", 1)]
YEARS = (1980, 2100)


def epoch_unit(df: DataFrame, column: str) -> str:
    """ns, us, ms or s, by the median magnitude."""
    median = df.agg(F.percentile(F.abs(F.expr(f"try_cast(`{column}` as double)")), 0.5)).first()[0]
    return next(u for least, u, _ in UNITS if (median or 0.0) >= least)


def from_epoch(x: Column, unit: str) -> Column:
    per = next(n for _, u, n in UNITS if u == unit)
    whole = x.cast("decimal(38,0)")
    return F.timestamp_micros((whole * 1_000_000 / per).cast("long") if per < 1_000_000 else F.floor(whole / (per // 1_000_000)).cast("long"))


def localized(naive: Column, zone: str) -> Column:
    """The instant of a local time (timestamp_ntz); null for one that the clock skips or shows twice."""
    if not zone:
        raise ValueError("naive timestamps need a time zone")
    there = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    at = F.convert_timezone(F.lit(zone), F.lit("UTC"), naive)
    hour = F.expr("interval 1 hour")
    return F.when((there(at) == naive) & (there(at + hour) != naive) & (there(at - hour) != naive), at)


def implausible(df: DataFrame, column: str, years: tuple[int, int] = YEARS) -> bool:
    """Whether any time is outside the years."""
    least, most = df.agg(F.min(F.year(column)), F.max(F.year(column))).first()
    return least is not None and (least < years[0] or most > years[1])


def parsed(df: DataFrame, column: str, zone: str | None = None, pattern: str | None = None, unit: str = "auto") -> DataFrame:
    """df with `column` as a UTC timestamp_ntz, null where it can't be read: by `pattern`; as it is where it has a zone; local to `zone` where
    naive; as an epoch where it is a number, or text of which more than 99 % are numbers; else text with or without an offset. Years out of range are an error."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    utc = lambda t: F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz"))
    number = F.expr(f"try_cast(`{column}` as decimal(38,0))")
    numbers = kind == "string" and pattern is None and (df.agg(F.avg(number.isNotNull().cast("int"))).first()[0] or 0.0) > 0.99
    if pattern is not None:
        out = localized(F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz"), zone)
    elif kind == "timestamp":
        out = utc(c)
    elif kind == "timestamp_ntz":
        out = localized(c, zone)
    elif kind != "string" or numbers:
        out = utc(from_epoch(number, epoch_unit(df, column) if unit == "auto" else unit))
    else:
        offset = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & c.rlike(r"\d:\d{2}")
        naive = F.expr(f"try_cast(`{column}` as timestamp_ntz)")
        out = F.when(offset, utc(F.expr(f"try_cast(`{column}` as timestamp)"))).otherwise(localized(naive, zone) if zone else F.lit(None).cast("timestamp_ntz"))
    df = df.withColumn(column, out)
    if implausible(df, column):
        raise ValueError(f"{column}: years out of {YEARS}; a wrong unit?")
    return df


def in_session(t: Column, opens: Column, closes: Column, label: str = "start") -> Column:
    """Whether a bar is of the session: its start in [open, close), or its end in (open, close]."""
    inside = (t >= opens) & (t < closes) if label == "start" else (t > opens) & (t <= closes)
    return F.coalesce(inside, F.lit(False))


def minute_of(t: Column, opens: Column, label: str = "start") -> Column:
    """Minutes from the open, halves to even; counted from 1."""
    micros = (F.unix_micros(t.cast("timestamp")) - F.unix_micros(opens.cast("timestamp")))
    return F.bround(micros / 60_000_000.0, 0).cast("int") + (1 if label == "start" else 0)


def on_grid(t: Column) -> Column:
    """Whether a time is a whole minute."""
    return F.unix_micros(t.cast("timestamp")) % 60_000_000 == 0


def decimals(x: Column, cap: int = 8) -> Column:
    """Decimal places after rounding to `cap`, without zeros at the end."""
    return F.length(F.rtrim(F.split_part(F.format_string(f"%.{cap}f", x), F.lit("."), F.lit(2)), F.lit("0")))
