"""Schedules of an exchange: which days are sessions and when they open and close, in UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import checks


def schedule(days: DataFrame, holidays: DataFrame, early: DataFrame, zone: str = "America/New_York", opens: str = "09:30", closes: str = "16:00") -> DataFrame:
    """(d, open, close, minutes, early) of days (d) that aren't on a weekend nor among holidays (d); those in early (d, closes) end sooner.

    open and close are UTC without a zone, so they move with daylight saving. A repeated or missing day counts once or not at all; a session that ends before it opens, or two early ends of a day, stop the job.
    """
    soon = checks.unique(early.where("d is not null").select("d", F.col("closes").alias("_soon")), "d")
    x = days.where("d is not null").select("d").distinct().where(~F.dayofweek("d").isin(1, 7)).join(holidays.select("d"), "d", "left_anti").join(soon, "d", "left")
    utc = lambda clock: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("d").cast("string"), clock)), zone)
    a, z = utc(F.lit(opens)), utc(F.coalesce("_soon", F.lit(closes)))
    x = x.select("d", a.alias("open"), z.alias("close"), ((F.unix_timestamp(z) - F.unix_timestamp(a)) / 60).cast("int").alias("minutes"), F.col("_soon").isNotNull().alias("early"))
    return checks.guarded(x, {"an end after the start": F.col("minutes") > 0})
