"""Queries of exchange schedules and of summaries by variant and period."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.windows import rolling
from tickloom.operators import exchange, performance, published, summaries
from tickloom.plans.catalogue import day, query, r8, returns
from tickloom.plans.reports import _ACTUAL, _PERIODS, LEDGER_SQL, ledger, periods, published_table, rounded
from tickloom.sources.bars import DAILY_SQL, daily

_SUMMER = "d >= make_date(year(d), 4, 1) + ((7 - dayofweek(make_date(year(d), 4, 1))) % 7)::INT AND d < make_date(year(d), 10, 31) - dayofweek(make_date(year(d), 10, 31))::INT"


@query(f", s AS (SELECT d, CASE WHEN day(d) = 24 THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END AS z, CASE WHEN {_SUMMER} THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS o, day(d) = 24 AS early FROM daily WHERE isodow(d) < 6 AND day(d) <> 25) SELECT d, d + INTERVAL 570 MINUTE + o AS open, d + z + o AS close, (CASE WHEN early THEN 210 ELSE 390 END)::INT AS minutes, early FROM s", DAILY_SQL)
def exchange_schedule(spark, sf):
    """Sessions of the days on which there are orders: none on the 25th, short ones on the 24th. The SQL has New York's summer of these years by rule."""
    d = daily(spark, sf).select("d")
    return exchange.schedule(d, d.where(F.dayofmonth("d") == 25), d.where(F.dayofmonth("d") == 24).withColumn("closes", F.lit("13:00")))


_VARIANTS = ", va(variant, k) AS (VALUES ('free', 0), ('base', 1), ('dear', 3)), vd AS (SELECT d, w, variant, k * commission AS commission, k * slippage AS slippage, -financing AS carry, notional FROM led JOIN per ON d BETWEEN a AND z CROSS JOIN va)"


@query(LEDGER_SQL + _PERIODS + _VARIANTS + """, s AS (SELECT variant, w, sum(commission) AS c, sum(slippage) AS s, sum(carry) AS f, sum(notional) AS n FROM vd GROUP BY 1, 2), l AS (SELECT variant, w, unnest(['commission', 'slippage', 'carry']) AS kind, unnest([c, s, f]) AS cost, c + s + f AS t, n FROM s)
 SELECT variant, w, kind, round(cost, 2) AS cost, round(cost / nullif(t, 0), 6) AS share, round(cost / nullif(n, 0) * 10000, 6) AS bps FROM l""", " ")
def cost_summary(spark, sf):
    """Costs by kind of three variants in three periods."""
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(k).alias("k")) for n, k in (("free", 0), ("base", 1), ("dear", 3))]))
    x = ledger(spark, sf).withColumn("v", v).select("d", "v.variant", *[(F.col("v.k") * F.col(c)).alias(c) for c in ("commission", "slippage")], (-F.col("financing")).alias("carry"), "notional")
    out = summaries.costs(performance.in_windows(x, periods(spark)), ("variant", "w"), ("commission", "slippage", "carry"))
    return out.select("variant", "w", "kind", F.round("cost", 2).alias("cost"), r8("share", 6).alias("share"), r8("bps", 6).alias("bps"))


@query(DAILY_SQL + ", rt AS (SELECT d, r, CASE WHEN count(r) OVER h = 14 THEN 1 / stddev_samp(r) OVER h END AS lev FROM ret WINDOW h AS (ORDER BY d ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)), x AS (SELECT *, CASE WHEN d < DATE '1998-01-01' THEN 'pre' ELSE 'post' END AS w, round(r * 1000, 4) AS net, (lev >= 2)::INT + (lev >= 3)::INT + (lev >= 4)::INT + (lev >= 6)::INT AS band FROM rt), g AS (SELECT w, band, count(*) AS sessions, sum(net) AS net, avg(r) * 10000 AS mean_bp, avg((r > 0)::INT) AS hit FROM x GROUP BY 1, 2) SELECT w, band::INT AS band, sessions, round(net, 4) AS net, round(mean_bp, 4) AS mean_bp, round(hit, 6) AS hit, round(net / sum(net) OVER (PARTITION BY w), 6) AS share FROM g", " ")
def leverage_attribution(spark, sf):
    """Results of two periods by bands of target leverage."""
    x = returns(spark, sf).withColumn("lev", F.try_divide(F.lit(1.0), rolling(F.stddev_samp, F.col("r"), day(), 14, 1)))
    x = x.select("lev", F.col("r").alias("ret"), F.round(F.col("r") * 1000, 4).alias("net"), F.when(F.col("d") < "1998-01-01", "pre").otherwise("post").alias("w"))
    out = summaries.by_band(x, ("w",), "lev", (2.0, 3.0, 4.0, 6.0))
    return out.select("w", "band", "sessions", r8("net", 4).alias("net"), r8("mean_bp", 4).alias("mean_bp"), r8("hit", 6).alias("hit"), r8("share", 6).alias("share"))


@query(LEDGER_SQL + ", x AS (SELECT year(d)::INT AS year, abs(round(net, 0) - (round(gross, 0) - round(commission, 0) - round(slippage, 0) + round(cash_interest, 0) + round(financing, 0))) AS gap FROM led) SELECT year, count(*) AS rows, count(*) FILTER (gap > 1.5) AS off, count(*) FILTER (gap IS NULL) AS unknown, round(max(gap), 4) AS most FROM x GROUP BY 1", " ")
def rounded_identity(spark, sf):
    """Each day's net against its parts, all printed in whole dollars: off by more than a dollar and a half on few days."""
    whole = ("net", "gross", "commission", "slippage", "cash_interest", "financing")
    x = ledger(spark, sf).select(F.year("d").alias("year"), *[F.round(c, 0).alias(c) for c in whole])
    out = summaries.identity(x, ("year",), "net", {"gross": 1, "commission": -1, "slippage": -1, "cash_interest": 1, "financing": 1}, 1.5)
    return out.withColumn("most", F.round("most", 4))


@query(LEDGER_SQL + " SELECT date_trunc('quarter', d)::DATE AS quarter, coalesce(string_agg(DISTINCT status, ',' ORDER BY status) FILTER (status IN ('unknown_exit', 'absent')), '') AS statuses FROM led GROUP BY 1", " ")
def incomplete_statuses(spark, sf):
    x = ledger(spark, sf).select(F.to_date(F.date_trunc("quarter", "d")).alias("quarter"), "status")
    return summaries.statuses(x, ("quarter",), "status", ("unknown_exit", "absent"))


@query(", v AS (SELECT d, r, CASE WHEN count(r) OVER h = 14 THEN stddev_samp(r) OVER h END AS vol, CASE WHEN d < DATE '1998-01-01' THEN 'pre' ELSE 'post' END AS w FROM ret WINDOW h AS (ORDER BY d ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)), q AS (SELECT *, ntile(5) OVER (PARTITION BY w ORDER BY vol, d)::INT AS quintile FROM v WHERE vol IS NOT NULL), g AS (SELECT quintile, count(*) FILTER (w = 'pre') AS pre_sessions, avg(r) FILTER (w = 'pre') * 10000 AS a, count(*) FILTER (w = 'post') AS post_sessions, avg(r) FILTER (w = 'post') * 10000 AS z FROM q GROUP BY 1) SELECT quintile, pre_sessions, round(a, 2) AS pre_bp, post_sessions, round(z, 2) AS post_bp, round(z - a, 2) AS change FROM g", DAILY_SQL)
def quintile_table(spark, sf):
    """Quintiles of volatility before and after 1998 beside each other, to a hundredth of a basis point: closes are in cents, and a mean that lies half-way is rounded either way."""
    x = returns(spark, sf).select("d", "r", rolling(F.stddev_samp, F.col("r"), day(), 14, 1).alias("vol"), F.when(F.col("d") < "1998-01-01", "pre").otherwise("post").alias("w"))
    return rounded(summaries.quintile_table(x, "vol", "r", "w", "pre", "post"), 2)


@query(LEDGER_SQL + _ACTUAL + " SELECT last_day(make_date(y, mo, 1)) AS d, published FROM pub", " ")
def month_end_records(spark, sf):
    """A printed table's months as records of their last days."""
    months, _ = published.long_months(published_table(spark, sf))
    return months.select(F.last_day(F.make_date("year", "month", F.lit(1))).alias("d"), "published")
