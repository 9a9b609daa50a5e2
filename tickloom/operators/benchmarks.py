"""Returns of a benchmark with dividends, on a calendar, with anchors; and a strategy held against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import metrics

POLICIES = ("null", "drop")


def on_calendar(calendar: DataFrame, events: DataFrame, value: str, at: str = "d") -> DataFrame:
    """calendar with `value` of events summed on each day, 0 where there is none. Events on other days vanish: off_calendar() lists them."""
    sums = events.groupBy(at).agg(F.sum(value).alias(value))
    return calendar.join(sums, at, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def off_calendar(calendar: DataFrame, events: DataFrame, at: str = "d") -> DataFrame:
    return events.join(calendar.select(at), at, "left_anti")


def total_returns(closes: DataFrame, dividends: DataFrame, policy: str = "null", anchor: bool = False) -> DataFrame:
    """(d, price, total) of closes (d, close, valid) and dividends (d, amount): returns over the row before, without and with the day's dividend.

    A close that isn't valid gives no return, nor does the day after it have one (null); or its day is left out, so the next return spans it (drop). anchor: the first close also stands on the day
    before, so that the first day has a return, of its dividend alone. One asset: a window over its days.
    """
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy}: {POLICIES}")
    rows = closes.select("d", F.when(F.coalesce("valid", F.lit(False)), F.col("close")).alias("close"))
    if policy == "drop":
        rows = rows.where("close is not null")
    rows = on_calendar(rows, dividends, "amount").withColumn("_real", F.lit(True))
    if anchor:
        first = rows.where("close is not null").agg(F.min("d").alias("d"), F.min_by("close", "d").alias("close")).where("d is not null")
        rows = rows.unionByName(first.select(F.date_sub("d", 1).alias("d"), "close", F.lit(0.0).alias("amount"), F.lit(False).alias("_real")))
    before = F.lag("close").over(Window.orderBy("d"))
    out = rows.select("d", (F.try_divide("close", before) - 1).alias("price"), (F.try_divide(F.col("close") + F.col("amount"), before) - 1).alias("total"), "_real")
    return out.where("_real").drop("_real")


def anchor_before(closes: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, anchor, close): for each start the last row strictly before it, null if there is none. One merge for all starts."""
    from tickloom.operators.curves import asof_before

    found = asof_before(starts.select(F.col("start").alias("d")).distinct(), closes.select("d", "close"), "d", ("close",))
    return found.select(F.col("d").alias("start"), F.col("observed").alias("anchor"), "close")


def figures(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row: growth, risk and relation of strategy (d, ret, evaluated) and benchmark (d, price, total), both on the days that are evaluated. A null return of the strategy is 0; a null one of the benchmark is left out."""
    s = strategy.where("evaluated").select("d", F.coalesce("ret", F.lit(0.0)).alias("s"))
    x = s.join(benchmark, "d", "left")
    years = metrics.years(F.col("d"))
    grown = lambda c: metrics.cagr(c, years)
    b, own = F.col("total"), F.when(F.col("total").isNotNull(), F.col("s"))
    beta = metrics.beta(own, b)
    root = F.sqrt(F.lit(252.0))
    return x.agg(
        years.alias("years"), F.count("*").alias("sessions"), F.count(b).alias("valid"), F.count_if(b.isNull()).alias("missing"), grown(F.col("price")).alias("price_cagr"), grown(b).alias("total_cagr"), (F.stddev_samp(b) * root).alias("total_vol"),
        (F.try_divide(F.avg(b), F.stddev_samp(b)) * root).alias("total_sharpe"), grown(F.col("s")).alias("strategy_cagr"), (grown(F.col("s")) - grown(b)).alias("excess_cagr"), beta.alias("beta"), ((F.avg(own) - beta * F.avg(b)) * 252).alias("alpha"),
        (F.try_divide(F.avg(own - b), F.stddev_samp(own - b)) * root).alias("information"),
    )


def ranked(c: str, *by: str) -> Column:
    """Ranks with ties averaged."""
    return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0


def correlations(pairs: DataFrame) -> DataFrame:
    """(freq, n, pearson, spearman, up_beta, down_beta, up_capture, down_capture) of pairs (d, r, b) by day, week, month and quarter: returns are compounded within each, all frequencies in one plan."""
    starts = F.array(*[F.struct(F.lit(f).alias("freq"), F.date_trunc(u, "d").cast("date").alias("of")) for f, u in (("D", "day"), ("W", "week"), ("M", "month"), ("Q", "quarter"))])
    x = pairs.select(F.explode(starts).alias("p"), "r", "b").groupBy("p.freq", "p.of").agg(metrics.total_return(F.col("r")).alias("r"), metrics.total_return(F.col("b")).alias("b"))
    x = x.withColumn("kr", ranked("r", "freq")).withColumn("kb", ranked("b", "freq"))
    r, b = F.col("r"), F.col("b")

    def side(up: bool) -> tuple[Column, Column]:
        ok = b > 0 if up else b < 0
        return metrics.beta(F.when(ok, r), F.when(ok, b)), F.try_divide(F.avg(F.when(ok, r)), F.avg(F.when(ok, b)))

    (ub, uc), (db, dc) = side(True), side(False)
    return x.groupBy("freq").agg(F.count("*").alias("n"), metrics.correlation(r, b).alias("pearson"), metrics.correlation(F.col("kr"), F.col("kb")).alias("spearman"), ub.alias("up_beta"), db.alias("down_beta"), uc.alias("up_capture"), dc.alias("down_capture"))


def relative(pairs: DataFrame) -> DataFrame:
    """One row of pairs (d, r, b): relative wealth, the day of the largest relative difference, and the growth a year of r with and without that day, which the baseline's return replaces."""
    g = F.log1p("r") - F.log1p("b")
    x = pairs.withColumn("g", g)
    top = x.agg(F.min_by("d", F.struct(-F.abs("g"), F.col("d"))).alias("top"))
    swapped = F.when(F.col("d") == F.col("top"), F.col("b")).otherwise(F.col("r"))
    years = metrics.years(F.col("d"))
    out = x.crossJoin(F.broadcast(top)).groupBy("top").agg(F.count("*").alias("n"), F.expm1(F.sum("g")).alias("relative"), metrics.cagr(F.col("r"), years).alias("cagr"), metrics.cagr(swapped, years).alias("cagr_without"))
    return out.withColumn("difference", F.col("cagr_without") - F.col("cagr"))
