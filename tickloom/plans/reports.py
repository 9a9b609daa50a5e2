"""Queries of daily results: metric tables, windows, attribution, published figures, bootstrap grids, packed series, made-up sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import metrics
from tickloom.operators import inference, packing, performance, published
from tickloom.plans.catalogue import query, r8, returns
from tickloom.sources import synthetic
from tickloom.sources.bars import BARS_SQL, DAILY_SQL, calendar, table

LEDGER_SQL = (
    DAILY_SQL
    + """, raw AS (SELECT l_shipdate::DATE AS d, l_extendedprice::DECIMAL(18,2) AS p, l_discount::DECIMAL(4,2) AS disc, l_tax::DECIMAL(4,2) AS tax, l_quantity::DECIMAL(12,2) AS q, l_returnflag AS f, l_linestatus AS s, l_linenumber AS k FROM lineitem),
 sums AS (SELECT d, coalesce(sum(p * (disc - 0.05)) FILTER (f = 'A'), 0)::DOUBLE AS long_gross, coalesce(sum(p * (disc - 0.05)) FILTER (f = 'R'), 0)::DOUBLE AS short_gross, sum(q)::DOUBLE AS shares, sum(p)::DOUBLE AS notional, sum(p * tax)::DOUBLE / 1000 AS slippage,
  coalesce(sum(p * disc) FILTER (s = 'O'), 0)::DOUBLE / -10000 AS financing, count(*) AS signals, count(*) FILTER (s = 'F') AS fills, count(*) FILTER (f <> 'N') AS units, sum(k)::BIGINT AS holding FROM raw GROUP BY 1),
 more AS (SELECT *, long_gross + short_gross AS gross, shares * 0.0035::DOUBLE AS commission, notional / 100000 AS cash_interest, (1000000 + 1000 * month(d))::DOUBLE AS prev_aum, CASE WHEN isodow(d) = 7 THEN 'absent' WHEN day(d) = 13 THEN 'unknown_exit' ELSE 'active' END AS status FROM sums),
 led AS (SELECT *, net / prev_aum AS ret0, CASE WHEN status <> 'absent' THEN net / prev_aum END AS ret, 0.0001::DOUBLE AS hurdle FROM (SELECT *, commission + slippage AS cost, gross - commission - slippage + cash_interest + financing AS net FROM more)),
 bm AS (SELECT d, close / lag(close) OVER (ORDER BY d) - 1 AS b FROM daily)"""
)


def ledger(spark, sf) -> DataFrame:
    """Daily results: the lines of a shipping day as its trades."""
    x = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"), *[F.col(c).cast(t).alias(n) for c, t, n in (("l_extendedprice", "decimal(18,2)", "p"), ("l_discount", "decimal(4,2)", "disc"), ("l_tax", "decimal(4,2)", "tax"), ("l_quantity", "decimal(12,2)", "q"))], F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("k"))
    edge, double = F.col("p") * (F.col("disc") - F.lit(0.05).cast("decimal(4,2)")), lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    side = lambda f: double(F.sum(F.when(F.col("f") == f, edge)))
    s = x.groupBy("d").agg(
        side("A").alias("long_gross"), side("R").alias("short_gross"), double(F.sum("q")).alias("shares"), double(F.sum("p")).alias("notional"), (double(F.sum(F.col("p") * F.col("tax"))) / 1000).alias("slippage"),
        (double(F.sum(F.when(F.col("s") == "O", F.col("p") * F.col("disc")))) / -10_000).alias("financing"), F.count("*").alias("signals"), F.count_if(F.col("s") == "F").alias("fills"), F.count_if(F.col("f") != "N").alias("units"), F.sum("k").alias("holding"),
    )
    s = s.withColumns({"gross": F.col("long_gross") + F.col("short_gross"), "commission": F.col("shares") * 0.0035, "cash_interest": F.col("notional") / 100_000, "prev_aum": (1_000_000 + 1_000 * F.month("d")).cast("double")})
    s = s.withColumn("status", F.when(F.dayofweek("d") == 1, "absent").when(F.dayofmonth("d") == 13, "unknown_exit").otherwise("active"))
    s = s.withColumn("cost", F.col("commission") + F.col("slippage")).withColumn("net", F.col("gross") - F.col("commission") - F.col("slippage") + F.col("cash_interest") + F.col("financing"))
    return s.withColumn("ret", F.when(F.col("status") != "absent", F.col("net") / F.col("prev_aum"))).withColumn("hurdle", F.lit(0.0001))


def moves(spark, sf) -> DataFrame:
    """The benchmark's (d, b)."""
    return returns(spark, sf).select("d", F.col("r").alias("b"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_PERIODS = ", per(w, a, z) AS (VALUES ('full', DATE '1900-01-01', DATE '2100-01-01'), ('pre', DATE '1900-01-01', DATE '1997-12-31'), ('post', DATE '1998-01-01', DATE '2100-01-01'))"


def periods(spark) -> DataFrame:
    rows = spark.sql("SELECT * FROM VALUES ('full', '1900-01-01', '2100-01-01'), ('pre', '1900-01-01', '1997-12-31'), ('post', '1998-01-01', '2100-01-01') AS t(w, a, z)")
    return rows.select("w", F.to_date("a").alias("a"), F.to_date("z").alias("z"))


_PERF = """, x AS (SELECT *, coalesce(ret, 0) AS x FROM t), y AS (SELECT *, product(1 + x) OVER (PARTITION BY w ORDER BY d ROWS UNBOUNDED PRECEDING) AS wealth FROM x), z AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY w ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM y),
 g AS (SELECT w, min(d) AS first, max(d) AS last, greatest(date_diff('day', min(d), max(d)), 1) / 365.2425 AS years, count(*) AS sessions, count(*) FILTER (status = 'active') AS active, product(1 + x) AS wealth, stddev_samp(x) AS sd, avg(x - hurdle) AS excess, min(dd) AS mdd, min(x) AS worst, avg((x > 0)::INT) FILTER (x <> 0) AS hit,
  sum(gross) AS gross, sum(commission) AS commission, sum(slippage) AS slippage, sum(cost) AS cost, sum(cash_interest) AS cash_interest, sum(financing) AS financing, sum(net) AS net, sum(signals)::BIGINT AS signals, sum(fills)::BIGINT AS fills, sum(units)::BIGINT AS units, sum(shares) AS shares, sum(notional) AS notional,
  avg(prev_aum) AS aum, sum(holding) AS holding, sum(long_gross) AS long_gross, sum(short_gross) AS short_gross, count(*) FILTER (status = 'unknown_exit') AS unknown_exits FROM z GROUP BY w)"""


@query(LEDGER_SQL + _PERIODS + ", t AS (SELECT led.*, w FROM led JOIN per ON d BETWEEN a AND z)" + _PERF + """ SELECT w, first, last, round(years, 6) AS years, sessions, active, round(wealth - 1, 6) AS total, round(pow(wealth, 1 / years) - 1, 6) AS cagr, round(sd * sqrt(252), 6) AS vol, round(excess / sd * sqrt(252), 6) AS sharpe, round(mdd, 6) AS mdd, round(worst, 6) AS worst, round(hit, 6) AS hit,
 round(gross, 2) AS gross, round(commission, 2) AS commission, round(slippage, 2) AS slippage, round(cost, 2) AS cost, round(cash_interest, 2) AS cash_interest, round(-financing, 2) AS financing_cost, round(net, 2) AS net, signals, fills, units, round(shares, 2) AS shares, round(notional, 2) AS notional, round(notional / aum, 2) AS turnover, round(holding / active, 2) AS holding_per_active,
 round(gross / shares, 2) AS gross_edge, round(cost / shares, 2) AS cost_edge, round(-financing / shares, 2) AS financing_edge, round((gross - cost + financing) / shares, 2) AS after_costs_edge, round(net / shares, 2) AS net_edge, round(long_gross, 2) AS long_gross, round(short_gross, 2) AS short_gross, unknown_exits FROM g""", " ")
def performance_table(spark, sf):
    """All figures of the whole time and of two periods of it."""
    out = performance.performance(performance.in_windows(ledger(spark, sf), periods(spark)), ("w",))
    fine = ("years", "total", "cagr", "vol", "sharpe", "mdd", "worst", "hit")
    return out.select(*[F.round(c, 6 if c in fine else 2).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_WINDOWS = ", per AS (SELECT strftime(m, '%Y-%m') AS w, m::DATE AS a, (m + INTERVAL 6 MONTH)::DATE - 1 AS z FROM (SELECT DISTINCT date_trunc('month', d) AS m FROM led))"


def half_years(spark, sf) -> DataFrame:
    """Windows of six months, one from each month of the ledger on."""
    m = ledger(spark, sf).select(F.trunc("d", "MM").alias("a")).distinct()
    return m.select(F.date_format("a", "yyyy-MM").alias("w"), "a", F.date_sub(F.add_months("a", 6), 1).alias("z"))


_AGAINST = """, t AS (SELECT led.*, w FROM led JOIN per ON d BETWEEN a AND z), bo AS (SELECT w, min(d) AS a, max(d) AS z FROM t GROUP BY w), th AS (SELECT bo.w, bm.d, b, t.w IS NOT NULL AS met, coalesce(ret, 0) AS ret FROM bm JOIN bo ON bm.d BETWEEN bo.a AND bo.z LEFT JOIN t ON t.w = bo.w AND t.d = bm.d)"""


@query(LEDGER_SQL + _WINDOWS + _AGAINST + _PERF + """, k AS (SELECT w, count(*) FILTER (b IS NULL) AS bare, product(1 + b) - 1 AS b_total, stddev_samp(b) * sqrt(252) AS b_vol, avg(b) / stddev_samp(b) * sqrt(252) AS b_sharpe, covar_samp(ret, b) FILTER (met) / var_pop(b) FILTER (met) AS beta, avg(ret) FILTER (met) AS mr, avg(b) FILTER (met) AS mb,
 avg(ret - b) FILTER (met) / stddev_samp(ret - b) FILTER (met) * sqrt(252) AS information FROM th GROUP BY w)
 SELECT g.w, sessions, active, round(wealth - 1, 6) AS total, round(excess / sd * sqrt(252), 6) AS sharpe, round(mdd, 6) AS mdd, CASE WHEN bare = 0 THEN round(b_total, 4) END AS b_total, CASE WHEN bare = 0 THEN round(b_vol, 6) END AS b_vol, CASE WHEN bare = 0 THEN round(b_sharpe, 6) END AS b_sharpe, CASE WHEN bare = 0 THEN round(beta, 6) END AS beta,
 CASE WHEN bare = 0 THEN round((mr - beta * mb) * 252, 6) END AS alpha, CASE WHEN bare = 0 THEN round(information, 6) END AS information FROM g LEFT JOIN k ON g.w = k.w""", " ")
def window_metrics(spark, sf):
    """Some eighty windows that overlap, all at once, with the benchmark of each."""
    led, win = ledger(spark, sf), half_years(spark, sf)
    own = performance.performance(performance.in_windows(led, win), ("w",)).select("w", "sessions", "active", *[r8(c, 6).alias(c) for c in ("total", "sharpe", "mdd")])
    other = performance.against_benchmark(led, moves(spark, sf), win)
    return own.join(other.select("w", *[r8(c, 4 if c == "b_total" else 6).alias(c) for c in other.columns[1:]]), "w", "left")


@query(LEDGER_SQL + _WINDOWS + _AGAINST + """, u AS (SELECT w, d, ret, NULL AS b FROM t UNION ALL SELECT w, d, NULL, b FROM th), days AS (SELECT w, d, product(1 + coalesce(ret, 0)) OVER (PARTITION BY w ORDER BY d) AS nav FROM t),
 bn AS (SELECT w, d, product(1 + b) OVER (PARTITION BY w ORDER BY d) AS b_nav FROM th WHERE b IS NOT NULL) SELECT days.w, days.d, round(nav, 6) AS nav, round(b_nav, 4) AS b_nav FROM days ASOF LEFT JOIN bn ON days.w = bn.w AND days.d >= bn.d""", " ")
def window_paths(spark, sf):
    """Wealth in each window, with the benchmark's last known on the strategy's days."""
    out = performance.paths(ledger(spark, sf), moves(spark, sf), half_years(spark, sf))
    return out.select("w", "d", r8("nav", 6).alias("nav"), r8("b_nav", 4).alias("b_nav"))


_QUARTER = "year(d)::VARCHAR || 'Q' || quarter(d)"


@query(LEDGER_SQL + f""", x AS (SELECT *, {_QUARTER} AS period, coalesce(ret, 0) AS x, ret IS NOT NULL AS here FROM led), y AS (SELECT *, product(1 + x) OVER (PARTITION BY period ORDER BY d ROWS UNBOUNDED PRECEDING) AS w, coalesce(product(1 + x) OVER (PARTITION BY period ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) / prev_aum AS after FROM x),
 z AS (SELECT *, w / greatest(1, max(w) OVER (PARTITION BY period ORDER BY d ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM y), th AS (SELECT {_QUARTER} AS period, min(d) AS a, max(d) AS z, product(1 + b) - 1 AS benchmark FROM bm WHERE b IS NOT NULL GROUP BY 1),
 g AS (SELECT period, min(d) AS first, max(d) AS last, product(1 + x) - 1 AS strategy, product(1 + CASE WHEN here THEN x - cash_interest / prev_aum ELSE 0 END) - 1 AS trading_only, min(dd) AS mdd, count(*) FILTER (status = 'active') AS active, count(*) AS sessions, sum(long_gross * after) FILTER (here) AS of_long_gross, sum(short_gross * after) FILTER (here) AS of_short_gross,
  -sum(commission * after) FILTER (here) AS of_commission, -sum(slippage * after) FILTER (here) AS of_slippage, sum(cash_interest * after) FILTER (here) AS of_cash_interest, sum(financing * after) FILTER (here) AS of_financing FROM z GROUP BY 1)
 SELECT g.period, first, last, round(strategy, 6) AS strategy, round(trading_only, 6) AS trading_only, round(least(mdd, 0), 6) AS mdd, active, sessions, round(of_long_gross, 6) AS of_long_gross, round(of_short_gross, 6) AS of_short_gross, round(of_commission, 6) AS of_commission, round(of_slippage, 6) AS of_slippage, round(of_cash_interest, 6) AS of_cash_interest, round(of_financing, 6) AS of_financing,
  round(benchmark, 4) AS benchmark, coalesce(first <= a AND last >= z, false) AS complete FROM g LEFT JOIN th ON g.period = th.period""", " ")
def period_attribution(spark, sf):
    """Quarters: what each part of a day's result adds to the quarter's return, linked through the days after it."""
    quarter = F.concat(F.year("d").cast("string"), F.lit("Q"), F.quarter("d").cast("string"))
    out = performance.attributed(ledger(spark, sf), moves(spark, sf), quarter)
    return rounded(out).withColumn("benchmark", r8("benchmark", 4))


_TRIPS = "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'pre' ELSE 'post' END AS w, CASE WHEN event_type IN ('click', 'purchase') THEN 'long' ELSE 'short' END AS side, hour(ts) * 20 + minute(ts) // 3 AS entry_minute, value::DECIMAL(18,4) - 50 AS gross, second(ts) AS holding FROM events"


def trips(spark, sf) -> DataFrame:
    """Events as round trips: a side, a minute of entry, a profit and a time held."""
    minute = F.hour("ts") * 20 + F.floor(F.minute("ts") / 3)
    return table(spark, sf, "events").select(F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "pre").otherwise("post").alias("w"), F.when(F.col("event_type").isin("click", "purchase"), "long").otherwise("short").alias("side"), minute.alias("entry_minute"), (F.col("value").cast("decimal(18,4)") - 50).alias("gross"), F.second("ts").alias("holding"))


_BUCKET = "CASE WHEN entry_minute <= 0 THEN NULL WHEN entry_minute <= 120 THEN 'open_1_120' WHEN entry_minute <= 270 THEN 'midday_121_270' ELSE 'close_271_plus' END"


@query(f"WITH t AS ({_TRIPS}) SELECT side, {_BUCKET} AS bucket, count(*) AS n, round(sum(gross)::DOUBLE, 4) AS gross, round(avg((gross > 0)::INT), 6) AS win_rate, round(sum(gross)::DOUBLE / count(*), 6) AS mean, round(avg(holding), 6) AS holding FROM t GROUP BY 1, 2")
def trip_stats(spark, sf):
    t = trips(spark, sf).withColumn("bucket", performance.entry_bucket(F.col("entry_minute")))
    out = performance.trip_stats(t, ("side", "bucket"))
    return out.select("side", "bucket", "n", F.round(F.col("gross").cast("double"), 4).alias("gross"), r8("win_rate", 6).alias("win_rate"), F.round(F.col("gross").cast("double") / F.col("n"), 6).alias("mean"), r8("holding", 6).alias("holding"))


@query(LEDGER_SQL + ", t AS (SELECT *, CASE WHEN d < DATE '1998-01-01' THEN 'pre' ELSE 'post' END AS w FROM led), tr AS (" + _TRIPS + f"), g AS (SELECT w, sum(long_gross) AS lg, sum(short_gross) AS sg, sum(signals)::DOUBLE AS n, sum(holding) / count(*) FILTER (status = 'active') AS hold, count(*) FILTER (status = 'active') AS active, sum(notional) / avg(prev_aum) AS turnover, sum(gross) / sum(shares) AS ge, sum(cost) / sum(shares) AS ce, -sum(financing) / sum(shares) AS fe FROM t GROUP BY 1)" + f""" SELECT w, component, bucket, round(value, 4) AS value, unit, observations FROM (
 SELECT w, 'long_vs_short' AS component, 'long_gross_pnl' AS bucket, lg AS value, 'USD' AS unit, NULL::BIGINT AS observations FROM g UNION ALL SELECT w, 'long_vs_short', 'short_gross_pnl', sg, 'USD', NULL FROM g UNION ALL SELECT w, 'signal_count', 'all', n, 'signals', NULL FROM g UNION ALL SELECT w, 'average_holding_minutes', 'active_session', hold, 'minutes', active FROM g
 UNION ALL SELECT w, 'turnover', 'traded_notional_over_average_aum', turnover, 'ratio', NULL FROM g UNION ALL SELECT w, 'gross_edge_per_traded_share', 'all', ge, 'USD_per_share', NULL FROM g UNION ALL SELECT w, 'cost_per_traded_share', 'execution', ce, 'USD_per_share', NULL FROM g UNION ALL SELECT w, 'cost_per_traded_share', 'financing_and_borrow', fe, 'USD_per_share', NULL FROM g
 UNION ALL SELECT w, 'entry_time_bucket', {_BUCKET} AS bucket, sum(gross)::DOUBLE, 'gross_USD', count(*) FROM tr WHERE entry_minute > 0 GROUP BY w, bucket)""", " ")
def decomposition_rows(spark, sf):
    """Long rows of two periods."""
    led = ledger(spark, sf).withColumn("w", F.when(F.col("d") < "1998-01-01", "pre").otherwise("post"))
    return performance.decomposed(led, ("w",), trips(spark, sf)).withColumn("value", r8("value", 4))


@query(LEDGER_SQL + _PERIODS + ", va(variant, k) AS (VALUES ('free', 0), ('base', 1), ('dear', 3)), t AS (SELECT w, variant, sum(gross - k * cost) AS net, avg((gross - k * cost) / prev_aum) AS mean FROM led JOIN per ON d BETWEEN a AND z CROSS JOIN va GROUP BY 1, 2) SELECT t.w, t.variant, round(t.net, 2) AS net, round(t.mean, 8) AS mean, round(t.net - b.net, 2) AS d_net, round(t.mean - b.mean, 8) AS d_mean FROM t JOIN t b ON t.w = b.w AND b.variant = 'base'", " ")
def variant_deltas(spark, sf):
    """Three levels of cost by period, and each less the base."""
    led = ledger(spark, sf).withColumn("v", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(k).alias("k")) for n, k in (("free", 0), ("base", 1), ("dear", 3))])))
    net = F.col("gross") - F.col("v.k") * F.col("cost")
    rows = performance.in_windows(led.select("d", "prev_aum", "v.variant", net.alias("net")), periods(spark))
    summary = rows.groupBy("w", "variant").agg(F.sum("net").alias("net"), F.avg(F.col("net") / F.col("prev_aum")).alias("mean"))
    out = performance.deltas(summary, "variant", "base", ("w",), ("net", "mean"))
    return out.select("w", "variant", *[F.round(c, 8 if "mean" in c else 2).alias(c) for c in ("net", "mean", "d_net", "d_mean")])


# Published figures.

_ACTUAL = """, mon AS (SELECT 'orders' AS variant, year(d)::INT AS y, month(d)::INT AS mo, product(1 + r) * 100 - 100 AS actual, count(*) AS sessions FROM ret WHERE r IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'lines', year(d)::INT, month(d)::INT, product(1 + ret) * 100 - 100, count(*) FROM led WHERE ret IS NOT NULL GROUP BY 2, 3),
 act AS (SELECT *, day(last_day(make_date(y, mo, 1)))::BIGINT AS due FROM mon), pub AS (SELECT y, mo, round(actual, 1) AS published FROM mon WHERE variant = 'orders' AND NOT (mo = 7 AND y % 2 = 1)),
 cmp AS (SELECT coalesce(w.variant, a.variant) AS variant, coalesce(w.y, a.y) AS y, coalesce(w.mo, a.mo) AS mo, published, actual, actual - published AS difference, CASE WHEN w.y IS NULL THEN 'not_published' WHEN a.y IS NULL THEN 'no_sessions' WHEN sessions < due THEN 'incomplete' ELSE '' END AS reason
  FROM (SELECT pub.*, variant FROM pub CROSS JOIN (SELECT DISTINCT variant FROM act)) w FULL JOIN act a ON a.variant = w.variant AND a.y = w.y AND a.mo = w.mo)"""


def monthly_actual(spark, sf) -> DataFrame:
    """(variant, year, month, actual, sessions, due): returns in per cent of two series, and how many days a month has."""
    both = returns(spark, sf).select("d", "r", F.lit("orders").alias("variant")).unionByName(ledger(spark, sf).select("d", F.col("ret").alias("r"), F.lit("lines").alias("variant")))
    m = both.where("r is not null").groupBy("variant", F.year("d").alias("year"), F.month("d").alias("month")).agg((F.product(1 + F.col("r")) * 100 - 100).alias("actual"), F.count("*").alias("sessions"))
    return m.withColumn("due", F.dayofmonth(F.last_day(F.make_date("year", "month", F.lit(1)))).cast("long"))


def published_table(spark, sf) -> DataFrame:
    """A wide table as it is printed: one place, some Julys left out."""
    m = monthly_actual(spark, sf).where("variant = 'orders' and not (month = 7 and year % 2 = 1)")
    wide = m.groupBy("year").pivot("month", list(range(1, 13))).agg(F.round(F.max("actual"), 1))
    return wide.select("year", *[F.col(str(k)).alias(n) for k, n in enumerate(published.MONTHS, 1)], F.lit(0.0).alias("yearly"))


def comparison(spark, sf) -> DataFrame:
    months, _ = published.long_months(published_table(spark, sf))
    return published.compared(months, monthly_actual(spark, sf), ("year", "month"), ("variant",))


@query(LEDGER_SQL + _ACTUAL + " SELECT variant, y AS year, mo AS month, published, round(actual, 4) AS actual, round(difference, 4) AS difference, reason, CASE WHEN reason IN ('not_published', 'no_sessions') THEN 'none' WHEN abs(difference) <= 0.03 THEN 'close' WHEN abs(difference) <= 1 THEN 'near' ELSE 'far' END AS class FROM cmp", " ")
def published_comparison(spark, sf):
    """Every printed month against two recomputed series, with the reason where they can't be compared."""
    out = published.classed(comparison(spark, sf), 0.03)
    return out.select("variant", "year", "month", "published", r8("actual", 4).alias("actual"), r8("difference", 4).alias("difference"), "reason", "class")


@query(LEDGER_SQL + _ACTUAL + ", c AS (SELECT *, abs(difference) AS x, reason = '' AS fine, reason IN ('', 'incomplete') AS there FROM cmp) SELECT variant, count(x) FILTER (there) AS available, round(avg(x) FILTER (there), 4) AS mae_available, count(x) FILTER (fine) AS comparable, round(avg(x) FILTER (fine), 4) AS mae, round(quantile_cont(x, 0.5) FILTER (fine), 4) AS median, round(max(x) FILTER (fine), 4) AS most, round(avg((x <= 0.03)::INT) FILTER (there) * 100, 4) AS available_within_0_03, round(avg((x <= 0.03)::INT) FILTER (fine) * 100, 4) AS comparable_within_0_03 FROM c GROUP BY 1", " ")
def published_errors(spark, sf):
    out = published.errors(comparison(spark, sf), ("variant",), (0.03,))
    return rounded(out, 4)


@query(LEDGER_SQL + _ACTUAL + " SELECT y AS year, max(mo)::INT AS last_month, 0.0::DOUBLE AS published FROM pub GROUP BY 1", " ")
def published_years(spark, sf):
    return published.long_months(published_table(spark, sf))[1]


# Inference, packing, made-up sessions.

_GRID = """, x AS (SELECT CASE WHEN d < DATE '1998-01-01' THEN 'pre' ELSE 'post' END AS period, d, r FROM ret WHERE r IS NOT NULL), nu AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY period) AS n FROM x),
 pt AS (SELECT period, sqrt(252) * avg(r - 0.0001) / stddev_samp(r) AS point FROM x GROUP BY 1), de AS (SELECT rep, method, block, period, n, b, ('0x' || md5('5|' || method || '|' || block || '|' || period || '|' || rep || '|' || b)[1:12])::BIGINT % CASE WHEN method = 'circular' THEN n ELSE greatest(n - block + 1, 1) END AS s
  FROM range(60) t(rep), (VALUES ('circular'), ('moving')) m(method), (VALUES (10), (20)) k(block), (SELECT DISTINCT period, n FROM nu), range(1000) u(b) WHERE b < ceil(n / block::DOUBLE)),
 dr AS (SELECT method, block, de.period, rep, sqrt(252) * avg(r - 0.0001) / stddev_samp(r) AS sharpe FROM de JOIN range(20) o(o) ON o < block AND b * block + o < n JOIN nu ON nu.period = de.period AND nu.i = (s + o) % de.n GROUP BY 1, 2, 3, 4),
 al AS (SELECT method, block, period, rep, sharpe, point, NULL AS c FROM dr JOIN pt USING (period) UNION ALL SELECT a.method, a.block, 'pre_minus_post', a.rep, a.sharpe - z.sharpe, p.point, a.sharpe - z.sharpe - p.point FROM dr a JOIN dr z ON a.method = z.method AND a.block = z.block AND a.rep = z.rep AND a.period = 'pre' AND z.period = 'post', (SELECT max(point) FILTER (period = 'pre') - max(point) FILTER (period = 'post') AS point FROM pt) p)"""


@query(_GRID + " SELECT method, block, period, level::DOUBLE AS level, round(any_value(point), 6) AS point, round(quantile_cont(sharpe, 0.5), 6) AS median, round(stddev_samp(sharpe), 6) AS sd, round(CASE WHEN level = 0.9 THEN quantile_cont(sharpe, 0.05) ELSE quantile_cont(sharpe, 0.025) END, 6) AS low, round(CASE WHEN level = 0.9 THEN quantile_cont(sharpe, 0.95) ELSE quantile_cont(sharpe, 0.975) END, 6) AS high, round(avg((c >= point)::INT), 6) AS one_sided, round(avg((abs(c) >= abs(point))::INT), 6) AS two_sided FROM al, (VALUES (0.9), (0.95)) l(level) GROUP BY 1, 2, 3, l.level", DAILY_SQL)
def bootstrap_grid(spark, sf):
    """Two methods, two block lengths, two periods and their difference, two levels; the SQL draws day by day."""
    x = returns(spark, sf).where("r is not null").select(F.when(F.col("d") < "1998-01-01", "pre").otherwise("post").alias("period"), "d", "r", F.lit(0.0001).alias("h"))
    points = x.groupBy("period").agg(metrics.sharpe(F.col("r"), 0.0001).alias("point"))
    draws = inference.sharpe_draws(x, ("circular", "moving"), (10, 20), 60, 5)
    return rounded(inference.grid_record(draws, points, "pre", "post", (0.9, 0.95)))


@query(LEDGER_SQL + " SELECT status, (row_number() OVER (PARTITION BY status ORDER BY d) - 1)::INT AS i, round(ret::FLOAT::DOUBLE, 12) AS ret, net::FLOAT::DOUBLE AS net, net > 0 AS won FROM led", " ")
def packed_series(spark, sf):
    """Daily results by status, packed to floats and bits and unpacked again."""
    led = ledger(spark, sf).withColumn("won", F.col("net") > 0)
    p = packing.packed(led, ("status",), "d", ("ret", "net"), ("won",))
    return packing.unpacked(p, ("status",), ("ret", "net"), ("won",)).withColumn("ret", F.round("ret", 12))


_U = "(('0x' || md5('7|' || d || '|' || m || '|{0}')[1:12])::BIGINT + 0.5::DOUBLE) / 281474976710656"


@query(", z AS (SELECT d, m, sqrt(-2 * ln(" + _U.format("u") + ")) * cos(2 * pi() * " + _U.format("v") + ") * 0.0003::DOUBLE AS z FROM (SELECT d, m FROM grid)), w AS (SELECT d, m, 400 * exp(sum(z) OVER (ORDER BY d, m)) AS open FROM z) SELECT d, m, round(open, 6) AS open, round(open + 0.05, 6) AS high, round(open - 0.05, 6) AS low, round(open + 0.01, 6) AS close FROM w", BARS_SQL)
def synthetic_walk(spark, sf):
    """A seeded walk over the sessions of events."""
    s = synthetic.sessions(calendar(spark, sf).withColumn("bars", F.lit(24)))
    return s.select("d", "m", *[r8(c, 6).alias(c) for c in ("open", "high", "low", "close")])


@query(", n AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k FROM (SELECT DISTINCT d FROM grid)) SELECT g.d, g.m, round(400 + k + g.m / 100, 6) AS open FROM grid g JOIN n ON g.d = n.d", BARS_SQL)
def synthetic_line(spark, sf):
    return synthetic.sessions(calendar(spark, sf).withColumn("bars", F.lit(24)), "linear").select("d", "m", r8("open", 6).alias("open"))
