"""Sessions cut from a tape by the clock, evidence of unadjusted prices, exits given from outside, results of sessions traded by minutes, costs that even out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators import checks, sizing


def _seconds(clock: str) -> int:
    h, m = clock.split(":")
    return int(h) * 3600 + int(m) * 60


def clock_range(ticks: DataFrame, ts: str = "ts", first: str = "09:30", last: str = "15:59") -> DataFrame:
    """Ticks whose time of day is from `first` to the instant `last`, both included. Ticks without a time are left out."""
    t = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), F.col(ts))
    return ticks.where(t.between(_seconds(first), _seconds(last)))


def session_bars(ticks: DataFrame, by: tuple[str, ...], at: tuple[str, ...], open: str = "open", high: str = "high", low: str = "low", close: str = "close", volume: Column | None = None) -> DataFrame:
    """(by, open, high, low, close, volume): the first open and the last close that are there, by the columns `at`; a group without any has nulls."""
    when = lambda c: F.when(F.col(c).isNotNull(), F.struct(*at))
    n = F.count("*") if volume is None else F.coalesce(F.sum(volume), F.lit(0))
    return ticks.groupBy(*by).agg(F.min_by(open, when(open)).alias("open"), F.max(high).alias("high"), F.min(low).alias("low"), F.max_by(close, when(close)).alias("close"), n.alias("volume"))


def dividends_of_file(lines: DataFrame, position: str, first: str, last: str, date: str = "date", amount: str = "dividend") -> DataFrame:
    """(d, amount) of lines of text: those that can't be read and those out of `first` to `last` are left out; of a date's lines the last by `position` counts. Names of columns in any case; an error without them."""
    known = {c.lower(): c for c in lines.columns}
    missing = [c for c in (date, amount) if c.lower() not in known]
    if missing:
        raise ValueError(f"dividends without {missing}")
    x = lines.select(F.col(known[date.lower()]).try_cast("date").alias("d"), F.col(known[amount.lower()]).try_cast("double").alias("amount"), F.col(position).alias("_at"))
    x = x.where(F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("amount").isNotNull() & ~F.isnan("amount"))
    return x.groupBy("d").agg(F.max_by("amount", "_at").alias("amount"))


def raw_price_evidence(days: DataFrame, dividends: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each `by`: whether days (by, d, open, close) look unadjusted for dividends (by, d, amount).

    On ex-dates the open falls by the dividend where prices are raw: then the gap with the dividend added back is nearer to other days' mean gap than the gap as it is. In per cent; null where no ex-date has a close before it
    or there is no other day. Dividends of one date are added; those off the calendar count for nothing.
    """
    cash = dividends.groupBy(*by, "d").agg(F.sum("amount").alias("_cash"))
    before = F.lag("close").over(Window.partitionBy(*by).orderBy("d"))
    x = days.withColumn("_before", before).join(cash, [*by, "d"], "left").withColumn("_cash", F.coalesce("_cash", F.lit(0.0)))
    ex = (F.col("_cash") > 0) & F.col("_before").isNotNull()
    x = x.select(*by, ex.alias("_ex"), (F.try_divide("open", "_before") - 1).alias("_gap"), (F.try_divide(F.col("open") + F.col("_cash"), F.col("_before")) - 1).alias("_added"))
    mean = lambda c, ok: F.avg(F.when(ok, F.col(c))) * 100
    base = mean("_gap", ~F.col("_ex"))
    raw, added = mean("_gap", F.col("_ex")), mean("_added", F.col("_ex"))
    return x.groupBy(*by).agg(
        F.count_if("_ex").alias("ex_dates"), base.alias("other_gap"), raw.alias("ex_gap"), added.alias("ex_gap_added"), (raw - base).alias("residual_raw"), (added - base).alias("residual_added"), (F.abs(added - base) < F.abs(raw - base)).alias("supports_raw")
    )


def exit_overrides(rows: DataFrame, price: str = "price", cost: str = "extra_cost_per_share") -> DataFrame:
    """(d, price, cost) of exits given from outside, as text or numbers: without a cost column it is 0. The job stops at a date that is missing or repeats, and at a price that isn't finite and above 0 or a cost below 0."""
    if price not in rows.columns:
        raise ValueError(f"exits without {price}")
    extra = F.col(cost).try_cast("double") if cost in rows.columns else F.lit(0.0)
    x = rows.select("d", F.col(price).try_cast("double").alias("price"), extra.alias("cost"))
    most = F.lit(float("inf"))
    return checks.unique(checks.guarded(x, {"a date": F.col("d").isNotNull(), "a price above 0": (F.col("price") > 0) & (F.col("price") < most), "a cost from 0": (F.col("cost") >= 0) & (F.col("cost") < most)}), "d")


def exits(days: DataFrame, overrides: DataFrame) -> DataFrame:
    """(d, price, cost, given) of days (d, price): the price given from outside where there is one."""
    o = overrides.select("d", F.col("price").alias("_price"), F.col("cost").alias("_cost"))
    return days.join(o, "d", "left").select("d", F.coalesce("_price", "price").alias("price"), F.coalesce("_cost", F.lit(0.0)).alias("cost"), F.col("_price").isNotNull().alias("given"))


def session_results(minutes: DataFrame, days: DataFrame, aum: float = 100_000.0, per_share: float = 0.0035, least: float = 0.35, **size) -> DataFrame:
    """(d, shares, units, gross, commission, net, ret) of minutes (d, m, exposure, pnl for a share) and days (d, day_open, vol).

    Shares are rounded; each unit of exposure that changes hands, the one left at the end too, costs `per_share` for each share and `least` at least. A session without an open has no row. `size` goes to sizing.leverage.
    """
    w = Window.partitionBy("d").orderBy("m")
    x = minutes.withColumn("_was", F.coalesce(F.lag("exposure").over(w), F.lit(0)))
    traded = x.groupBy("d").agg((F.sum(F.abs(F.col("exposure") - F.col("_was"))) + F.abs(F.max_by("exposure", "m"))).cast("long").alias("units"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("_gross"))
    x = days.where("day_open is not null").join(traded, "d").withColumn("shares", sizing.shares(F.lit(aum), F.col("day_open"), sizing.leverage(F.col("vol"), **size), "round"))
    x = x.withColumn("gross", F.col("_gross") * F.col("shares")).withColumn("commission", F.col("units") * F.greatest(F.lit(least), per_share * F.col("shares"))).withColumn("net", F.col("gross") - F.col("commission"))
    return x.select("d", "shares", "units", "gross", "commission", "net", (F.col("net") / aum).alias("ret"))


def evaluation(daily: DataFrame) -> DataFrame:
    """daily with is_evaluation, by its status, and no return outside of it."""
    inside = F.coalesce(sizing.evaluated(F.col("status")), F.lit(False))
    return daily.withColumn("is_evaluation", inside).withColumn("ret", F.when(inside, F.col("ret")))


def calendar_sharpe(daily: DataFrame, by: tuple[str, ...], rf_annual: float = 0.0, per_year: int = 252) -> DataFrame:
    """(by, sessions, sharpe) over evaluated sessions, those without a return as 0; null where returns don't vary."""
    x = F.coalesce("ret", F.lit(0.0))
    return daily.where("is_evaluation").groupBy(*by).agg(F.count("*").alias("sessions"), (F.when(F.stddev_samp(x) > 0, (F.avg(x) - rf_annual / per_year) / F.stddev_samp(x)) * F.sqrt(F.lit(float(per_year)))).alias("sharpe"))


def break_even(summary: DataFrame, on: tuple[str, ...], variant: str, value: str, baseline: str, low: tuple[str, float], high: tuple[str, float]) -> DataFrame:
    """(on, bps): the cost at which a variant, known at the costs `low` and `high` (name, basis points), is worth what the baseline is, on the line through both. One aggregation; null where one of three is missing."""
    of = lambda name: F.max(F.when(F.col(variant) == name, F.col(value)))
    a, z = of(low[0]), of(high[0])
    slope = F.when(z.isNotNull(), F.greatest(a - z, F.lit(1e-12)))
    return summary.groupBy(*on).agg((low[1] + (a - of(baseline)) / slope * (high[1] - low[1])).alias("bps"))


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every value that is given; None asks for nothing. A column that isn't there is an error."""
    missing = set(wanted) - set(df.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)}")
    for c, v in wanted.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def top(df: DataFrame, value: str, ties: tuple[str, ...], n: int = 20) -> DataFrame:
    """The n rows of the largest value; rows without one come last, ties by `ties`."""
    return df.orderBy(F.col(value).desc_nulls_last(), *ties).limit(n)
