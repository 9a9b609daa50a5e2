"""Figures of daily results: by any windows of days, against a benchmark, by parts of the return, and of round trips.

A row of daily results is a session d with status, ret, hurdle, prev_aum, sums of profit and cost (gross, long_gross, short_gross, commission, slippage, cost, cash_interest, financing, net: financing is below 0 where it costs)
and counts (signals, fills, units, shares, notional, holding).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import metrics

PARTS = ("long_gross", "short_gross", "commission", "slippage", "cash_interest", "financing")
#: Minutes of the session up to which an entry is early, and up to which it is at midday.
ENTRY = (120, 270)


def in_windows(days: DataFrame, windows: DataFrame, at: str = "d", width: int = 64) -> DataFrame:
    """days with the window w (w, a, z) that each is in; a day in several windows comes several times. They meet by bins of `width` days, so no day is compared with windows far from it."""
    bin_of = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / width)
    binned = windows.where("a <= z").select("w", "a", "z", F.explode(F.sequence(bin_of("a"), bin_of("z"))).alias("_bin"))
    joined = days.withColumn("_bin", bin_of(at)).join(binned, "_bin").where(F.col(at).between(F.col("a"), F.col("z")))
    return joined.drop("_bin", "a", "z")


def _per(x: Column, n: Column) -> Column:
    return F.when(n > 0, x / n)


def _drawdown(df: DataFrame, by: tuple[str, ...], r: Column, anchored: bool) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_w", F.product(1 + r).over(w))
    peak = F.max("_w").over(w)
    return df.withColumn("_dd", F.col("_w") / (F.greatest(F.lit(1.0), peak) if anchored else peak) - 1)


def performance(daily: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """34 figures a group: dates, growth and risk, sums, counts, and costs and profits for each share traded. A null return counts as 0; a ratio over nothing is null."""
    x = F.coalesce("ret", F.lit(0.0))
    y, shares, s = metrics.years(F.col("d")), F.sum("shares"), F.sum
    rows = _drawdown(daily, by, x, False)
    active = F.count_if(F.col("status") == "active")
    return rows.groupBy(*by).agg(
        F.min("d").alias("first"), F.max("d").alias("last"), y.alias("years"), F.count("*").alias("sessions"), active.alias("active"), metrics.total_return(x).alias("total"), metrics.cagr(x, y).alias("cagr"), (F.stddev_samp(x) * F.sqrt(F.lit(252.0))).alias("vol"),
        F.when(F.stddev_samp(x) > 0, F.avg(x - F.coalesce("hurdle", F.lit(0.0))) / F.stddev_samp(x) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.min("_dd").alias("mdd"), F.min(x).alias("worst"), metrics.hit_rate(x).alias("hit"),
        *[s(c).alias(c) for c in ("gross", "commission", "slippage", "cost", "cash_interest")], (-s("financing")).alias("financing_cost"), *[s(c).alias(c) for c in ("net", "signals", "fills", "units", "shares", "notional")],
        _per(s("notional"), F.avg("prev_aum")).alias("turnover"), (s("holding") / F.greatest(active, F.lit(1))).alias("holding_per_active"),
        _per(s("gross"), shares).alias("gross_edge"), _per(s("cost"), shares).alias("cost_edge"), _per(-s("financing"), shares).alias("financing_edge"), _per(s("gross") - s("cost") + s("financing"), shares).alias("after_costs_edge"), _per(s("net"), shares).alias("net_edge"),
        s("long_gross").alias("long_gross"), s("short_gross").alias("short_gross"), F.count_if(F.col("status") == "unknown_exit").alias("unknown_exits"),
    )


def against_benchmark(daily: DataFrame, benchmark: DataFrame, windows: DataFrame) -> DataFrame:
    """(w, b_total, b_vol, b_sharpe, beta, alpha, information) of all windows at once; benchmark (d, b) has returns over its row before, null on its first.

    A window's benchmark goes from the strategy's first session in it to its last, over its own days; beta, alpha and information are of days that both have. Null for a window whose first return
    has nothing before it.
    """
    ours = in_windows(daily.select("d", F.coalesce("ret", F.lit(0.0)).alias("ret")), windows)
    bounds = ours.groupBy("w").agg(F.min("d").alias("a"), F.max("d").alias("z"))
    theirs = in_windows(benchmark.select("d", "b"), bounds)
    both = theirs.join(ours, ["w", "d"], "left")
    b, r = F.col("b"), F.col("ret")
    pair = F.when(r.isNotNull(), b)
    beta = metrics.beta(r, pair)
    root = F.sqrt(F.lit(252.0))
    got = both.groupBy("w").agg(
        F.count_if(b.isNull()).alias("_bare"), metrics.total_return(b).alias("b_total"), (F.stddev_samp(b) * root).alias("b_vol"), (F.try_divide(F.avg(b), F.stddev_samp(b)) * root).alias("b_sharpe"),
        beta.alias("beta"), ((F.avg(F.when(pair.isNotNull(), r)) - beta * F.avg(pair)) * 252).alias("alpha"), (F.try_divide(F.avg(r - b), F.stddev_samp(r - b)) * root).alias("information"),
    )
    return got.select("w", *[F.when(F.col("_bare") == 0, F.col(c)).alias(c) for c in got.columns[2:]])


def paths(daily: DataFrame, benchmark: DataFrame, windows: DataFrame) -> DataFrame:
    """(w, d, nav, b_nav): wealth of each window from 1, and the benchmark's, carried to the strategy's days."""
    ours = in_windows(daily.select("d", F.coalesce("ret", F.lit(0.0)).alias("ret")), windows)
    bounds = ours.groupBy("w").agg(F.min("d").alias("a"), F.max("d").alias("z"))
    both = ours.join(in_windows(benchmark.select("d", "b"), bounds), ["w", "d"], "full")
    w = Window.partitionBy("w").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("nav", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w)).withColumn("b_nav", F.when(F.count("b").over(w) > 0, F.product(1 + F.coalesce("b", F.lit(0.0))).over(w)))
    return both.where("ret is not null").select("w", "d", "nav", "b_nav")


def attributed(daily: DataFrame, benchmark: DataFrame, period: Column) -> DataFrame:
    """A row a period: returns of the strategy, of trading alone (without interest on cash) and of the benchmark, the drawdown from 1, sessions, whether the period's benchmark days are within the strategy's, and each
    part's contribution: its share of a day's return times the growth of all days after it in the period. Contributions add up to the return where parts add up to each day's."""
    x = F.coalesce("ret", F.lit(0.0))
    here = F.col("ret").isNotNull()
    of = {c: F.when(here, F.col(c) * (-1 if c in ("commission", "slippage") else 1) / F.col("prev_aum")).otherwise(0.0) for c in PARTS}
    trading = F.when(here, x - F.col("cash_interest") / F.col("prev_aum")).otherwise(0.0)
    rows = _drawdown(daily.withColumn("period", period), ("period",), x, True)
    after = F.coalesce(F.product(1 + x).over(Window.partitionBy("period").orderBy("d").rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))
    rows = rows.withColumn("_after", after)
    ours = rows.groupBy("period").agg(
        F.min("d").alias("first"), F.max("d").alias("last"), metrics.total_return(x).alias("strategy"), metrics.total_return(trading).alias("trading_only"), F.least(F.min("_dd"), F.lit(0.0)).alias("mdd"),
        F.count_if(F.col("status") == "active").alias("active"), F.count("*").alias("sessions"), *[F.sum(part * F.col("_after")).alias(f"of_{c}") for c, part in of.items()],
    )
    theirs = benchmark.where("b is not null").withColumn("period", period).groupBy("period").agg(F.min("d").alias("_a"), F.max("d").alias("_z"), metrics.total_return(F.col("b")).alias("benchmark"))
    both = ours.join(theirs, "period", "left").withColumn("complete", F.coalesce((F.col("first") <= F.col("_a")) & (F.col("last") >= F.col("_z")), F.lit(False)))
    return both.drop("_a", "_z")


def entry_bucket(minute: Column) -> Column:
    """open_1_120, midday_121_270 or close_271_plus; null up to minute 0."""
    return F.when(minute <= 0, None).when(minute <= ENTRY[0], "open_1_120").when(minute <= ENTRY[1], "midday_121_270").when(minute.isNotNull(), "close_271_plus")


def trip_stats(trips: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, n, gross, win_rate, mean, holding) of round trips (gross, holding)."""
    return trips.groupBy(*by).agg(F.count("*").alias("n"), F.sum("gross").alias("gross"), F.avg((F.col("gross") > 0).cast("int")).alias("win_rate"), F.avg("gross").alias("mean"), F.avg("holding").alias("holding"))


def decomposed(daily: DataFrame, by: tuple[str, ...], trips: DataFrame | None = None) -> DataFrame:
    """(by, component, bucket, value, unit, observations): profit by side, signals, holding, turnover and profits and costs a share as long rows, one aggregation for all; with trips (by, entry_minute, gross), also by the minute of entry."""
    active, shares, s = F.count_if(F.col("status") == "active"), F.sum("shares"), F.sum
    rows = [
        ("long_vs_short", "long_gross_pnl", s("long_gross"), "USD", None), ("long_vs_short", "short_gross_pnl", s("short_gross"), "USD", None), ("signal_count", "all", s("signals").cast("double"), "signals", None),
        ("average_holding_minutes", "active_session", s("holding") / F.greatest(active, F.lit(1)), "minutes", active), ("turnover", "traded_notional_over_average_aum", _per(s("notional"), F.avg("prev_aum")), "ratio", None),
        ("gross_edge_per_traded_share", "all", _per(s("gross"), shares), "USD_per_share", None), ("cost_per_traded_share", "execution", _per(s("cost"), shares), "USD_per_share", None), ("cost_per_traded_share", "financing_and_borrow", _per(-s("financing"), shares), "USD_per_share", None),
    ]
    none = F.lit(None).cast("long")
    cells = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(b).alias("bucket"), v.cast("double").alias("value"), F.lit(u).alias("unit"), (none if n is None else n).alias("observations")) for c, b, v, u, n in rows])
    out = daily.groupBy(*by).agg(cells.alias("_cells")).select(*by, F.inline("_cells"))
    if trips is not None:
        bucket = trips.withColumn("bucket", entry_bucket(F.col("entry_minute"))).where("bucket is not null").groupBy(*by, "bucket").agg(F.sum("gross").cast("double").alias("value"), F.count("*").alias("observations"))
        out = out.unionByName(bucket.select(*by, F.lit("entry_time_bucket").alias("component"), "bucket", "value", F.lit("gross_USD").alias("unit"), "observations"))
    return out


def deltas(summary: DataFrame, variant: str, baseline: str, on: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """summary with d_ columns: each variant's figures less the baseline's of the same `on`."""
    base = summary.where(F.col(variant) == baseline).select(*on, *[F.col(c).alias(f"_{c}") for c in columns])
    return summary.join(base, list(on), "left").select(*summary.columns, *[(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in columns])


def reporting(daily: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Carry apart from trading, a group: returns and growth with and without interest on cash, the interest of a year, and its share of the simple sum of returns (null over 0)."""
    x = F.coalesce("ret", F.lit(0.0))
    cash = F.when(F.col("ret").isNotNull(), F.col("cash_interest") / F.col("prev_aum")).otherwise(0.0)
    years = metrics.years(F.col("d"))
    return daily.groupBy(*by).agg(
        metrics.total_return(x).alias("portfolio_total"), metrics.total_return(x - cash).alias("trading_total"), metrics.cagr(x, years).alias("portfolio_cagr"), metrics.cagr(x - cash, years).alias("trading_cagr"),
        (F.avg(cash) * 252).alias("cash_annualised"), F.try_divide(F.sum(cash), F.sum(x)).alias("cash_share"),
        (F.avg(F.when(F.col("status") == "active", F.col("ret"))) * 1e4).alias("active_mean_bp"), (F.stddev_samp(F.when(F.col("status") == "active", F.col("ret"))) * 1e4).alias("active_sd_bp"),
    )


def capital(daily: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Use of capital, a group, of daily with scheduled minutes and sums of dollars times minutes (gross_minutes, cash_minutes, borrowed_minutes): ratios of sums, null over 0."""
    s = lambda x: F.sum(x)
    aum, held = s(F.col("prev_aum") * F.col("scheduled")), s(F.col("prev_aum") * F.col("holding"))
    over = lambda a, b: F.when(b > 0, a / b)
    return daily.groupBy(*by).agg(
        over(s("gross_minutes"), aum).alias("utilisation"), over(s("holding"), s("scheduled")).alias("time_in_market"), over(s("gross_minutes"), held).alias("held_leverage"), over(s("cash_minutes"), aum).alias("cash"), over(s("borrowed_minutes"), aum).alias("borrowed")
    )
