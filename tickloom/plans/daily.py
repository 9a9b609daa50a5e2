"""Queries of sessions cut by the clock, raw prices, exits from outside, naive sessions, evaluated returns and costs that even out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.windows import rolling
from tickloom.operators import daily as D
from tickloom.operators import features as X
from tickloom.plans.catalogue import FB, day, query, r8, returns
from tickloom.plans.reports import LEDGER_SQL, ledger, rounded
from tickloom.sources.bars import DAILY_SQL, HOLED_SQL, grid, holed, table

_CLOCK = "k AS (SELECT *, ts::DATE AS d FROM events WHERE ts::TIME BETWEEN TIME '09:30:00' AND TIME '15:59:00'), b AS (SELECT d, event_type AS symbol, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM k GROUP BY 1, 2)"


def clocked(spark, sf) -> DataFrame:
    """Bars a session and symbol, a type of event as a symbol, of ticks in regular hours."""
    e = D.clock_range(table(spark, sf, "events").select("ts", "event_id", "event_type", "value"))
    e = e.select(F.to_date("ts").alias("d"), F.col("event_type").alias("symbol"), "ts", "event_id", *[F.col("value").alias(c) for c in ("open", "high", "low", "close")])
    return D.session_bars(e, ("d", "symbol"), ("ts", "event_id"))


@query(" SELECT * FROM b", _CLOCK)
def clock_range_daily(spark, sf):
    return clocked(spark, sf)


@query(""", c AS (SELECT symbol, d, round(open * 0.02, 4) AS amount FROM b WHERE day(d) % 7 = 0), x AS (SELECT b.*, lag(close) OVER (PARTITION BY b.symbol ORDER BY b.d) AS pc, coalesce(amount, 0) AS a FROM b LEFT JOIN c ON c.symbol = b.symbol AND c.d = b.d), y AS (SELECT symbol, a > 0 AND pc IS NOT NULL AS ex, open / pc - 1 AS g, (open + a) / pc - 1 AS ga FROM x),
 z AS (SELECT symbol, count(*) FILTER (ex) AS ex_dates, avg(g) FILTER (NOT ex) * 100 AS o, avg(g) FILTER (ex) * 100 AS e, avg(ga) FILTER (ex) * 100 AS ea FROM y GROUP BY 1)
 SELECT symbol, ex_dates, round(o, 4) AS other_gap, round(e, 4) AS ex_gap, round(ea, 4) AS ex_gap_added, round(e - o, 4) AS residual_raw, round(ea - o, 4) AS residual_added, abs(ea - o) < abs(e - o) AS supports_raw FROM z""", _CLOCK)
def raw_price_evidence(spark, sf):
    """A fiftieth of the open goes ex on every seventh day."""
    b = clocked(spark, sf)
    cash = b.where(F.dayofmonth("d") % 7 == 0).select("symbol", "d", F.round(F.col("open") * 0.02, 4).alias("amount"))
    return rounded(D.raw_price_evidence(b, cash, ("symbol",)), 4)


_LINES = "WITH l AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 7 = 3 THEN 'n/a' ELSE o_orderdate::DATE::VARCHAR END AS t, CASE WHEN o_orderkey % 11 = 5 THEN '' ELSE (round(o_totalprice / 1000, 2))::DECIMAL(18,2)::VARCHAR END AS a FROM orders)"


@query(_LINES + " SELECT d, arg_max(amount, pos) AS amount FROM (SELECT pos, try_cast(t AS DATE) AS d, try_cast(a AS DOUBLE) AS amount FROM l) WHERE d BETWEEN DATE '1995-03-01' AND DATE '1997-06-30' AND amount IS NOT NULL GROUP BY 1")
def dividends_of_file(spark, sf):
    """Orders as lines of a file in which some dates and amounts can't be read."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") / 1000, 2).cast("decimal(18,2)").cast("string")
    lines = o.select(k.alias("pos"), F.when(k % 7 == 3, "n/a").otherwise(F.to_date("o_orderdate").cast("string")).alias("Date"), F.when(k % 11 == 5, "").otherwise(cents).alias("Dividend"))
    return D.dividends_of_file(lines, "pos", "1995-03-01", "1997-06-30")


_OUTSIDE = """, c AS (SELECT d, arg_max(close, m) AS price FROM bars GROUP BY 1), o AS (SELECT d, round(price * 1.001, 4) AS price, CASE WHEN day(d) % 2 = 0 THEN 0.01 ELSE 0 END AS cost FROM c WHERE isodow(d) < 4)"""


@query(_OUTSIDE + " SELECT c.d, round(coalesce(o.price, c.price), 6) AS price, coalesce(cost, 0)::DOUBLE AS cost, o.d IS NOT NULL AS given FROM c LEFT JOIN o ON o.d = c.d", HOLED_SQL)
def overridden_exits(spark, sf):
    """Last prices of sessions, replaced from Monday to Wednesday by text from outside."""
    c = holed(spark, sf).groupBy("d").agg(F.max_by("close", "m").alias("price"))
    given = c.where(F.dayofweek("d").between(2, 4)).select("d", F.round(F.col("price") * 1.001, 4).cast("string").alias("price"), F.when(F.dayofmonth("d") % 2 == 0, "0.01").otherwise("0").alias("extra_cost_per_share"))
    return D.exits(c, D.exit_overrides(given)).withColumn("price", r8("price", 6))


@query(""", p AS (SELECT *, coalesce(last_value(plain IGNORE NULLS) OVER (PARTITION BY d ORDER BY m ROWS UNBOUNDED PRECEDING), 0) AS position FROM f5), e AS (SELECT d, m, close, coalesce(lag(position) OVER (PARTITION BY d ORDER BY m), 0) AS exposure FROM p),
 e2 AS (SELECT *, coalesce(lag(exposure) OVER (PARTITION BY d ORDER BY m), 0) AS was, exposure * (close - lag(close) OVER (PARTITION BY d ORDER BY m)) AS pnl FROM e), t AS (SELECT d, (sum(abs(exposure - was)) + abs(arg_max(exposure, m)))::BIGINT AS units, coalesce(sum(pnl), 0) AS g FROM e2 GROUP BY 1),
 dr AS (SELECT d, day_open, last_close / lag(last_close) OVER (ORDER BY d) - 1 AS r FROM o), dv AS (SELECT d, day_open, CASE WHEN count(r) OVER h = 5 THEN stddev_samp(r) OVER h END AS vol FROM dr WINDOW h AS (ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
 s AS (SELECT dv.d, units, g, round_even(100000 / day_open * CASE WHEN vol IS NULL THEN 4 ELSE least(0.4 / vol, 4) END, 0)::BIGINT AS shares FROM dv JOIN t ON t.d = dv.d WHERE day_open IS NOT NULL)
 SELECT d, shares, units, round(g * shares, 4) AS gross, round(units * greatest(0.35, 0.0035::DOUBLE * shares), 4) AS commission, round(g * shares - units * greatest(0.35, 0.0035::DOUBLE * shares), 4) AS net, round((g * shares - units * greatest(0.35, 0.0035::DOUBLE * shares)) / 100000, 8) AS ret FROM s""", FB)
def naive_sessions(spark, sf):
    """Sessions of the strategy without VWAP: a flat decision ends a position, a session without a volatility has the most leverage, and what is held at the end is sold."""
    f = X.features(grid(spark, sf), confirm=False)
    days = f.groupBy("d").agg(F.max("day_open").alias("day_open"), F.max_by("close", F.when(F.col("close").isNotNull(), F.col("m"))).alias("last_close"))
    days = days.withColumn("r", F.try_divide(F.col("last_close"), F.lag("last_close").over(Window.orderBy("d"))) - 1)
    days = days.withColumn("vol", rolling(F.stddev_samp, F.col("r"), day(), 5, 1))
    out = D.session_results(X.exposure(f), days, target=0.4, null_vol="max")
    return out.select("d", "shares", "units", *[r8(c, 4).alias(c) for c in ("gross", "commission", "net")], r8("ret").alias("ret"))


_STATUS = LEDGER_SQL + ", ev AS (SELECT d, status NOT IN ('unknown_exit', 'absent') AS is_evaluation, CASE WHEN status NOT IN ('unknown_exit', 'absent') THEN ret END AS ret FROM led)"


def evaluated(spark, sf) -> DataFrame:
    led = ledger(spark, sf).withColumn("status", F.when(F.col("status") == "absent", "absent_session").otherwise(F.col("status")))
    return D.evaluation(led).select("d", "is_evaluation", "ret")


@query(_STATUS + " SELECT d, is_evaluation, round(ret, 8) AS ret FROM ev", " ")
def evaluated_returns(spark, sf):
    return evaluated(spark, sf).withColumn("ret", r8("ret"))


@query(_STATUS + ", x AS (SELECT year(d)::INT AS year, coalesce(ret, 0) AS x FROM ev WHERE is_evaluation) SELECT year, count(*) AS sessions, round(CASE WHEN stddev_samp(x) > 0 THEN (avg(x) - 0.02::DOUBLE / 252) / stddev_samp(x) END * sqrt(252), 6) AS sharpe FROM x GROUP BY 1", " ")
def calendar_sharpe(spark, sf):
    out = D.calendar_sharpe(evaluated(spark, sf).withColumn("year", F.year("d")), ("year",), 0.02)
    return out.withColumn("sharpe", r8("sharpe", 6))


@query(LEDGER_SQL + ", s AS (SELECT year(d)::INT AS year, sum(net) AS base, sum(net) * 1.001::DOUBLE + sum(notional) * 0.0001::DOUBLE - 0.5::DOUBLE * sum(notional) / 10000 AS lo, sum(net) * 1.001::DOUBLE + sum(notional) * 0.0001::DOUBLE - sum(notional) / 10000 AS hi FROM led GROUP BY 1) SELECT year, round(0.5 + (lo - base) / greatest(lo - hi, 1e-12) * 0.5, 6) AS bps FROM s", " ")
def break_even_bps(spark, sf):
    """Another exit is worth a basis point of notional and a thousandth of the result; what may it cost?"""
    net, notional = F.sum("net"), F.sum("notional")
    other = net * 1.001 + notional * 0.0001
    led = ledger(spark, sf).groupBy(F.year("d").alias("year")).agg(net.alias("minute"), (other - notional * 0.5 / 10_000).alias("other_half"), (other - notional / 10_000).alias("other_one"))
    summary = led.unpivot(["year"], ["minute", "other_half", "other_one"], "variant", "net")
    return D.break_even(summary, ("year",), "variant", "net", "minute", ("other_half", 0.5), ("other_one", 1.0)).withColumn("bps", r8("bps", 6))


@query(", v AS (SELECT d, CASE WHEN count(r) OVER h = 14 THEN stddev_samp(r) OVER h END AS vol FROM ret WINDOW h AS (ORDER BY d ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) SELECT d, round(0.02 / vol, 8) AS leverage FROM v ORDER BY 0.02 / vol DESC NULLS LAST, d LIMIT 20", DAILY_SQL)
def top_leverage(spark, sf):
    """The twenty sessions of the largest leverage without a cap."""
    v = returns(spark, sf).select("d", F.try_divide(F.lit(0.02), rolling(F.stddev_samp, F.col("r"), day(), 14, 1)).alias("leverage"))
    return D.top(v, "leverage", ("d",)).withColumn("leverage", r8("leverage"))


@query("SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1996 GROUP BY 1, 2, 3")
def matrix_selection(spark, sf):
    """Cells of a status and a year, of any priority."""
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"))
    return D.matching(o, o_orderstatus="F", year=1996, o_orderpriority=None).groupBy(*o.columns).agg(F.count("*").alias("n"))
