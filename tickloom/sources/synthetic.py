"""Sessions of made-up prices: a line, or a seeded random walk that runs on through all sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, STEP = 400.0, 3e-4


def uniform(*of) -> Column:
    """A number between 0 and 1, by the MD5 of its arguments as text: the same in every run, on every machine, in every engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[F.lit(x).cast("string") if not isinstance(x, Column) else x.cast("string") for x in of])), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(*of) -> Column:
    return F.sqrt(-2 * F.ln(uniform(*of, "u"))) * F.cos(2 * F.pi() * uniform(*of, "v"))


def sessions(schedule: DataFrame, kind: str = "walk", seed: int = 7, start: float = START, step: float = STEP) -> DataFrame:
    """(d, m, open, high, low, close, volume) for each minute of a schedule (d, bars). linear: start + k + m / 100 in session k. walk: start times e to the sum of `step` normal numbers, one a minute.

    A session's steps are summed in tasks of their own; only one number a session goes through the window over sessions, and each session's walk starts from it.
    """
    if kind not in ("walk", "linear"):
        raise ValueError(f"no sessions of kind {kind}")
    slots = schedule.where("bars > 0").select("d", F.explode(F.sequence(F.lit(1), F.col("bars"))).alias("m"))
    days = Window.orderBy("d")
    if kind == "linear":
        number = schedule.select("d", (F.row_number().over(days) - 1).alias("k"))
        rows = slots.join(number, "d").withColumn("open", F.lit(start) + F.col("k") + F.col("m") / 100)
    else:
        steps = slots.withColumn("z", normal(seed, F.col("d"), F.col("m")) * F.lit(step))
        before = F.coalesce(F.sum("z").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        starts = steps.groupBy("d").agg(F.sum("z").alias("z")).select("d", before.alias("_from"))
        within = F.sum("z").over(Window.partitionBy("d").orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
        rows = steps.withColumn("_at", within).join(starts, "d").withColumn("open", F.lit(start) * F.exp(F.col("_from") + F.col("_at")))
    return rows.select("d", "m", "open", (F.col("open") + 0.05).alias("high"), (F.col("open") - 0.05).alias("low"), (F.col("open") + 0.01).alias("close"), F.lit(1000.0).alias("volume"))
