"""Rates as they were known: as-of merges of two inputs, and daily curves of two segments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RATES = ("benchmark_rate_percent", "cash_rate_annual", "funding_rate_annual", "borrow_rate_annual")
#: Ways in which a curve can be wrong, in the order in which they are reported.
RULES = ("repeated_session", "missing_session", "unknown_session", "rate")


def asof_before(left: DataFrame, right: DataFrame, at: str = "d", values: tuple[str, ...] = ("rate",), keys: tuple[str, ...] = (), every: str = "month") -> DataFrame:
    """left with, of the latest row of right strictly before `at`: its time as `observed`, and `values`; null where there is none. right has one row a key and time.

    The different times of both sides are merged by a union. They are dealt to tasks by key and calendar period (`every`); the last observation of each period is carried
    into those after it, by a window over one row a period, and within a period rows are carried in order. So a task holds a period's times however many rows left has at one
    of them; left meets the result by equal times.
    """
    seen = F.struct(F.col(at).alias("observed"), *values)
    times = left.select(*keys, at).where(F.col(at).isNotNull()).distinct().withColumn("_seen", F.lit(None).cast(right.select(seen.alias("s")).schema["s"].dataType)).withColumn("_side", F.lit(0))
    both = times.unionByName(right.where(F.col(at).isNotNull()).select(*keys, at, seen.alias("_seen"), F.lit(1).alias("_side"))).withColumn("_period", F.date_trunc(every, at))
    last = both.groupBy(*keys, "_period").agg(F.max_by("_seen", F.when(F.col("_side") == 1, F.col(at))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1))
    start = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_period").alias("_p"), before.alias("_start"))
    on = F.col("_period") == F.col("_p")
    for k in keys:
        on &= F.col(k) == F.col(f"_k_{k}")
    # At one time, left comes first: what right has there isn't strictly before.
    inside = F.last("_seen", ignorenulls=True).over(Window.partitionBy(*keys, "_period").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, -1))
    found = both.join(start, on).select(*keys, at, "_side", F.coalesce(inside, F.col("_start")).alias("_of")).where("_side = 0")
    return left.join(found.select(*keys, at, "_of"), [*keys, at], "left").select(*left.columns, "_of.*")


def point_in_time(
    sessions: DataFrame, monthly: DataFrame, daily: DataFrame, monthly_until: str, daily_from: str, cash_bps: float = 0.0, funding_bps: float = 0.0, borrow_bps: float = 0.0, stale_days: int | None = None, names: tuple[str, str] = ("monthly", "daily")
) -> DataFrame:
    """A row a session (d): the benchmark's name, the observation that was known, the rule by which, its rate in percent, rates of cash, funding and borrowing, its age in days.

    Up to monthly_until the rate is that of the month before (monthly: month, rate), from daily_from on the latest daily one strictly before (daily: d, rate). Sessions between the two, or
    whose rate nobody had published yet, or whose daily rate is older than stale_days, have null rates; curve_faults() counts them.
    """
    until, from_ = dt.date.fromisoformat(monthly_until), dt.date.fromisoformat(daily_from)
    if until >= from_:
        raise ValueError(f"the daily segment has to start after the monthly one: {until}, {from_}")
    days = sessions.select("d").withColumn("month", F.add_months(F.trunc("d", "MM"), -1))
    first = days.where(F.col("d") <= F.lit(until)).join(monthly.select(F.trunc("month", "MM").alias("month"), "rate"), "month", "left")
    first = first.select("d", F.lit(names[0]).alias("benchmark"), F.when(F.col("rate").isNotNull(), F.date_format("month", "yyyy-MM")).alias("observation"), F.lit("previous_completed_month").alias("policy"), "rate", F.datediff("d", F.last_day("month")).alias("age"))
    second = asof_before(days.where(F.col("d") >= F.lit(from_)).select("d"), daily.select("d", "rate"))
    second = second.select("d", F.lit(names[1]).alias("benchmark"), F.col("observed").cast("string").alias("observation"), F.lit("latest_strictly_before").alias("policy"), "rate", F.datediff("d", "observed").alias("age"))
    if stale_days is not None:
        second = second.withColumn("rate", F.when(F.col("age") <= stale_days, F.col("rate")))
    between = days.where((F.col("d") > F.lit(until)) & (F.col("d") < F.lit(from_))).select("d", *[F.lit(None).cast("string").alias(c) for c in ("benchmark", "observation", "policy")], F.lit(None).cast("double").alias("rate"), F.lit(None).cast("int").alias("age"))
    both = first.unionByName(second).unionByName(between)
    annual = lambda bps: F.col("rate") / 100 + F.lit(bps / 10_000)
    borrow = F.when(F.col("rate").isNotNull(), F.lit(borrow_bps / 10_000))
    return both.select("d", "benchmark", "observation", "policy", F.col("rate").alias(RATES[0]), annual(cash_bps).alias(RATES[1]), annual(funding_bps).alias(RATES[2]), borrow.alias(RATES[3]), "age")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def curve_faults(curve: DataFrame, sessions: DataFrame, rates: tuple[str, ...] = RATES) -> DataFrame:
    """(rule, n): sessions that a curve (d, rates) repeats, misses, or has beyond `sessions` (d), and those whose rates aren't all finite. One full join of the days of both."""
    missing = [c for c in ("d", *rates) if c not in curve.columns]
    if missing:
        raise ValueError(f"curve without {missing}")
    fine = _finite(F.col(rates[0]))
    for c in rates[1:]:
        fine &= _finite(F.col(c))
    own = curve.groupBy("d").agg(F.count("*").alias("n"), F.count_if(~fine).alias("bad"))
    both = own.join(sessions.select("d").distinct().withColumn("_here", F.lit(True)), "d", "full")
    counts = both.agg(F.count_if(F.col("n") > 1).alias(RULES[0]), F.count_if(F.col("n").isNull()).alias(RULES[1]), F.count_if(F.col("_here").isNull()).alias(RULES[2]), F.count_if(F.col("bad") > 0).alias(RULES[3]))
    return counts.unpivot([], list(RULES), "rule", "n").where("n > 0")


def checked_curve(curve: DataFrame, sessions: DataFrame, rates: tuple[str, ...] = RATES) -> DataFrame:
    """The curve; an error that names what is wrong with it."""
    found = {r.rule: r.n for r in curve_faults(curve, sessions, rates).collect()}
    if found:
        raise ValueError("curve: " + ", ".join(f"{rule} ({found[rule]})" for rule in RULES if rule in found))
    return curve
