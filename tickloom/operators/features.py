"""Intraday features and signals on the dense grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.windows import carried, rolling

#: Sessions of history for the noise band, how many must be there, minutes between decisions, width of the band.
HISTORY, AT_LEAST, EVERY, BAND = 5, 3, 3, 1.0


def session():
    return Window.partitionBy("d").orderBy("m")


def minute():
    return Window.partitionBy("m").orderBy("d")


def typical_price(kind: str):
    return {"hlc3": (F.col("high") + F.col("low") + F.col("close")) / 3, "ohlc4": (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4}[kind]


def with_vwap(grid: DataFrame, kind: str = "hlc3", halted=None) -> DataFrame:
    """Adds vwap: volume-weighted typical price since the open; halted minutes weigh nothing."""
    px, w = typical_price(kind), session().rowsBetween(Window.unboundedPreceding, 0)
    vol = F.col("volume").cast("double")
    vol = vol if halted is None else F.when(halted, F.lit(0.0)).otherwise(vol)
    return grid.withColumn("vwap", F.when(px.isNotNull(), F.try_divide(F.sum(vol * px).over(w), F.sum(F.when(px.isNotNull(), vol)).over(w))))


def with_move(grid: DataFrame) -> DataFrame:
    """Adds day_open, the first open of the session, and move, the distance of the close from it."""
    day = F.first("open", ignorenulls=True).over(session().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return grid.withColumn("day_open", day).withColumn("move", F.abs(F.try_divide(F.col("close"), F.col("day_open")) - 1))


def with_sigma(grid: DataFrame, n: int = HISTORY, at_least: int = AT_LEAST) -> DataFrame:
    """Adds sigma, the mean move of this minute over the n sessions before, and how many of them had one."""
    return grid.withColumn("sigma", rolling(F.avg, F.col("move"), minute(), n, 1, at_least)).withColumn("history", F.coalesce(F.count("move").over(minute().rowsBetween(-n, -1)), F.lit(0)))


def with_previous_close(grid: DataFrame, dividends: DataFrame | None = None) -> DataFrame:
    """Adds prev_close: the last close of the session before, null if that had none; less the dividend (d, amount) that goes ex on this one, if dividends are given."""
    days = grid.groupBy("d").agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("m"))).alias("last_close"))
    days = days.select(F.col("d"), F.lag("last_close").over(Window.orderBy("d")).alias("prev_close"))
    if dividends is not None:
        cash = dividends.groupBy("d").agg(F.sum("amount").alias("_amount"))
        days = days.join(cash, "d", "left").select("d", (F.col("prev_close") - F.coalesce("_amount", F.lit(0.0))).alias("prev_close"))
    return grid.join(days, "d")


def coverage(grid: DataFrame, window: int, usable, every: int = EVERY) -> DataFrame:
    """(d, m, usable, eligible, prior_usable, warm) of decision minutes: how many of the `window` sessions before that scheduled this minute had a usable value there.

    grid has scheduled minutes alone, so a session that closed early isn't counted against later minutes; `warm` where all of `window` had one.
    """
    g = grid.where(F.pmod("m", F.lit(every)) == 0).select("d", "m", F.coalesce(usable, F.lit(False)).alias("usable"))
    w = minute().rowsBetween(-window, -1)
    prior = F.coalesce(F.sum(F.col("usable").cast("int")).over(w), F.lit(0))
    return g.select("d", "m", "usable", F.count("*").over(w).alias("eligible"), prior.alias("prior_usable"), (prior >= window).alias("warm"))


def with_signal(grid: DataFrame, confirm: bool = True, band: float = BAND, every: int = EVERY) -> DataFrame:
    """Adds upper, lower and signal (1, -1 or 0): a break of the noise band, confirmed by the VWAP if `confirm`, at decision minutes."""
    g = grid.withColumn("upper", F.greatest("day_open", "prev_close") * (1 + band * F.col("sigma"))).withColumn("lower", F.least("day_open", "prev_close") * (1 - band * F.col("sigma")))
    up, down = F.col("close") > F.col("upper"), F.col("close") < F.col("lower")
    if confirm:
        up, down = up & (F.col("close") > F.col("vwap")), down & (F.col("close") < F.col("vwap"))
    admissible = (F.pmod("m", F.lit(every)) == 0) & F.col("sigma").isNotNull() & F.col("prev_close").isNotNull() & F.col("close").isNotNull()
    return g.withColumn("signal", F.when(admissible, F.when(up, 1).when(down, -1).otherwise(0)))


def features(grid: DataFrame, dividends: DataFrame | None = None, **k) -> DataFrame:
    return with_signal(with_previous_close(with_sigma(with_move(with_vwap(grid))), dividends), **k)


def exposure(signals: DataFrame) -> DataFrame:
    """Adds position (the last decision persists), exposure (one row later) and pnl (exposure times the change of the close)."""
    s = signals.withColumn("position", F.coalesce(carried(F.col("signal"), session()), F.lit(0)))
    s = s.withColumn("exposure", F.coalesce(F.lag("position").over(session()), F.lit(0)))
    return s.withColumn("pnl", F.col("exposure") * (F.col("close") - F.lag("close").over(session())))
