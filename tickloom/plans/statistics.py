"""Queries of daily returns: metrics, comparisons, attribution, inference."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import metrics
from tickloom.functions.windows import carried, rolling, wealth
from tickloom.operators import inference
from tickloom.plans.catalogue import day, pair, query, r8, returns
from tickloom.sources.bars import DAILY_SQL, daily

_R = ", x AS (SELECT * FROM ret WHERE r IS NOT NULL)"
_YEARS = "(greatest(date_diff('day', min(d), max(d)), 1) / 365.2425)"


def _known(spark, sf):
    return returns(spark, sf).where("r is not null")


@query(f"{_R} SELECT count(*) AS n, round({_YEARS}, 8) AS years, round(product(1 + r) - 1, 6) AS total, round(pow(product(1 + r), 1 / {_YEARS}) - 1, 6) AS cagr, round(avg(r - 0.0001) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(avg(r) FILTER (abs(r) > 0.05) * 1e4, 4) AS active_mean_bp, round(stddev_samp(r) FILTER (abs(r) > 0.05) * 1e4, 4) AS active_sd_bp FROM x", DAILY_SQL)
def growth_and_sharpe(spark, sf):
    r, active = F.col("r"), F.when(F.abs("r") > 0.05, F.col("r"))
    y = metrics.years(F.col("d"))
    return _known(spark, sf).agg(F.count("*").alias("n"), r8(y).alias("years"), r8(metrics.total_return(r), 6).alias("total"), r8(metrics.cagr(r, y), 6).alias("cagr"), r8(metrics.sharpe(r, 0.0001), 6).alias("sharpe"), r8(F.avg(active) * 1e4, 4).alias("active_mean_bp"), r8(F.stddev_samp(active) * 1e4, 4).alias("active_sd_bp"))


_DD = ", w AS (SELECT d, r, product(1 + r) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS w FROM x), k AS (SELECT *, w / max(w) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd, w / greatest(1, max(w) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) - 1 AS anchored FROM w)"


@query(f"{_R}{_DD} SELECT round(min(dd), 8) AS mdd, round(min(anchored), 8) AS mdd_from_one, round(pow(product(1 + r), 252.0 / count(*)) - 1, 6) AS cagr_of_count, round(avg(r) * 252 / (stddev_samp(r) FILTER (r < 0) * sqrt(252)), 6) AS sortino, round((pow(product(1 + r), 252.0 / count(*)) - 1) / -min(dd), 6) AS calmar, round(avg((r > 0)::INT) FILTER (r <> 0), 8) AS hit FROM k", DAILY_SQL)
def drawdown_and_ratios(spark, sf):
    x = _known(spark, sf).withColumn("w", wealth(F.col("r"), day()))
    peak = F.max("w").over(day().rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("dd", F.col("w") / peak - 1).withColumn("anchored", F.col("w") / F.greatest(F.lit(1.0), peak) - 1)
    r = F.col("r")
    return x.agg(r8(F.min("dd")).alias("mdd"), r8(F.min("anchored")).alias("mdd_from_one"), r8(metrics.cagr_of_count(r), 6).alias("cagr_of_count"), r8(metrics.sortino(r), 6).alias("sortino"), r8(F.try_divide(metrics.cagr_of_count(r), -F.min("dd")), 6).alias("calmar"), r8(metrics.hit_rate(r)).alias("hit"))


@query(", m AS (SELECT date_trunc('month', d) AS mo, product(1 + r) - 1 AS r FROM ret WHERE r IS NOT NULL GROUP BY 1) SELECT count(*) AS n, round(stddev_samp(r) * sqrt(12), 6) AS vol, round(pow(product(1 + r), 12.0 / count(*)) - 1, 6) AS cagr, round(avg((r > 0)::INT), 6) AS hit FROM m", DAILY_SQL)
def monthly_metrics(spark, sf):
    m = _known(spark, sf).groupBy(F.trunc("d", "MM").alias("mo")).agg(metrics.total_return(F.col("r")).alias("r"))
    r = F.col("r")
    return m.agg(F.count("*").alias("n"), r8(F.stddev_samp(r) * F.sqrt(F.lit(12.0)), 6).alias("vol"), r8(metrics.cagr_of_count(r, 12), 6).alias("cagr"), r8(F.avg((r > 0).cast("int")), 6).alias("hit"))


@query(", w AS (SELECT date_trunc('month', d)::DATE AS mo, arg_max(close, d) AS c FROM daily GROUP BY 1) SELECT mo, round(c / (SELECT c FROM w WHERE mo < DATE '1996-01-01' ORDER BY mo DESC LIMIT 1), 8) AS nav FROM w WHERE mo >= DATE '1996-01-01'", DAILY_SQL)
def nav_rebased(spark, sf):
    """Month ends over the last one before the window."""
    m = daily(spark, sf).groupBy(F.trunc("d", "MM").alias("mo")).agg(F.max_by("close", "d").alias("c"))
    start = m.where("mo < date'1996-01-01'").agg(F.max_by("c", "mo").alias("base"))
    return m.where("mo >= date'1996-01-01'").crossJoin(F.broadcast(start)).select("mo", r8(F.try_divide("c", "base")).alias("nav"))


@query(" SELECT d, date_diff('day', lag(d) OVER (ORDER BY d), d)::INT AS elapsed FROM daily", DAILY_SQL)
def elapsed_days(spark, sf):
    return daily(spark, sf).select("d", F.datediff("d", F.lag("d").over(day())).alias("elapsed"))


@query(", c AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM daily), p AS (SELECT c.d, close, last_value(close IGNORE NULLS) OVER (ORDER BY c.d ROWS UNBOUNDED PRECEDING) AS f FROM c LEFT JOIN (SELECT * FROM daily WHERE day(d) <> 13) k ON c.d = k.d) SELECT d, round(f / lag(f) OVER (ORDER BY d) - 1, 8) AS r, coalesce(close IS NOT NULL AND lag(close) OVER (ORDER BY d) IS NOT NULL, false) AS valid, coalesce(sum((close IS NOT NULL)::INT) OVER (ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) >= 5, false) AS history_valid FROM p", DAILY_SQL)
def padded_returns(spark, sf):
    """Returns over closes carried across absent sessions, and whether today's, yesterday's and the last five closes are there."""
    d = daily(spark, sf)
    c = d.agg(F.min("d").alias("a"), F.max("d").alias("z")).where("a is not null").select(F.explode(F.sequence("a", "z")).alias("d"))
    p = c.join(d.where(F.dayofmonth("d") != 13), "d", "left").withColumn("f", carried(F.col("close"), day()))
    here = F.col("close").isNotNull()
    before = F.lag(here).over(day())
    history = F.sum(here.cast("int")).over(day().rowsBetween(-5, -1)) >= 5
    return p.select("d", r8(F.try_divide("f", F.lag("f").over(day())) - 1).alias("r"), F.coalesce(here & before, F.lit(False)).alias("valid"), F.coalesce(history, F.lit(False)).alias("history_valid"))


@query(", t AS (SELECT d, close, CASE WHEN day(d) = 15 THEN close * 0.01 ELSE 0 END AS div FROM daily) SELECT d, round((close + div) / lag(close) OVER (ORDER BY d) - 1, 8) AS total, round(close / lag(close) OVER (ORDER BY d) * (1 + div / lag(close) OVER (ORDER BY d)) - 1, 8) AS compounded, round(lag(close) OVER (ORDER BY d) - div, 8) AS prev_adjusted FROM t", DAILY_SQL)
def total_returns(spark, sf):
    """With dividends added to the price, or compounded; and the close before, less today's dividend."""
    t = daily(spark, sf).withColumn("div", F.when(F.dayofmonth("d") == 15, F.col("close") * 0.01).otherwise(0.0))
    prev = F.lag("close").over(day())
    return t.select("d", r8(F.try_divide(F.col("close") + F.col("div"), prev) - 1).alias("total"), r8(F.try_divide(F.col("close"), prev) * (1 + F.try_divide(F.col("div"), prev)) - 1).alias("compounded"), r8(prev - F.col("div")).alias("prev_adjusted"))


@query(" SELECT d, round(CASE WHEN count(r) OVER h >= 13 THEN avg(abs(r)) OVER h END, 8) AS sigma FROM ret WINDOW h AS (ORDER BY d ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)", DAILY_SQL)
def legacy_sigma(spark, sf):
    return returns(spark, sf).select("d", r8(rolling(F.avg, F.abs("r"), day(), 14, 1, 13)).alias("sigma"))


@query(" SELECT d, round(CASE WHEN count(r) OVER h = 14 THEN stddev_samp(r) OVER h END, 8) AS vol FROM ret WINDOW h AS (ORDER BY d ROWS BETWEEN 15 PRECEDING AND 2 PRECEDING)", DAILY_SQL)
def legacy_daily_vol(spark, sf):
    return returns(spark, sf).select("d", r8(rolling(F.stddev_samp, F.col("r"), day(), 14, 2)).alias("vol"))


@query(", g AS (SELECT d, CASE WHEN day(d) < 11 THEN 'a' WHEN day(d) < 21 THEN 'b' ELSE 'c' END AS regime FROM daily) SELECT d, was, regime FROM (SELECT d, regime, lag(regime) OVER (ORDER BY d) AS was FROM g) WHERE was <> regime", DAILY_SQL)
def regime_seams(spark, sf):
    n = F.dayofmonth("d")
    g = daily(spark, sf).select("d", F.when(n < 11, "a").when(n < 21, "b").otherwise("c").alias("regime"))
    return g.withColumn("was", F.lag("regime").over(day())).where("was <> regime").select("d", "was", "regime")


@query(", y AS (SELECT year(d)::INT AS y, avg((close > 150000)::INT) AS s FROM daily GROUP BY 1), t AS (SELECT y, s, s - lag(s) OVER (ORDER BY y) AS step FROM y) SELECT round(max(abs(step)), 8) AS step, (SELECT y FROM t WHERE step IS NOT NULL ORDER BY abs(step) DESC, y LIMIT 1) AS y FROM t", DAILY_SQL)
def largest_yearly_step(spark, sf):
    y = daily(spark, sf).groupBy(F.year("d").alias("y")).agg(F.avg((F.col("close") > 150000).cast("int")).alias("s"))
    y = y.withColumn("step", F.abs(F.col("s") - F.lag("s").over(Window.orderBy("y")))).where("step is not null")
    return y.agg(r8(F.max("step")).alias("step"), F.min_by("y", F.struct(-F.col("step"), F.col("y"))).alias("y"))


@query(" SELECT d, year(d)::INT AS y, strftime(d, '%Y-%m') AS m, year(d)::VARCHAR || 'Q' || quarter(d) AS q, (d + ((5 - isodow(d) + 7) % 7)::INT)::DATE AS friday FROM daily", DAILY_SQL)
def period_labels(spark, sf):
    return daily(spark, sf).select("d", F.year("d").alias("y"), F.date_format("d", "yyyy-MM").alias("m"), F.concat(F.year("d").cast("string"), F.lit("Q"), F.quarter("d")).alias("q"), F.next_day(F.date_sub("d", 1), "FRI").alias("friday"))


@query(" SELECT max(d) AS anchor, arg_max(close, d) AS close FROM daily WHERE d < DATE '1995-06-15'", DAILY_SQL)
def anchor_before(spark, sf):
    return daily(spark, sf).where("d < date'1995-06-15'").agg(F.max("d").alias("anchor"), F.max_by("close", "d").alias("close"))


_VOL = ", v AS (SELECT d, r, CASE WHEN count(r) OVER h = 5 THEN stddev_samp(r) OVER h END AS v FROM ret WINDOW h AS (ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), c AS (SELECT quantile_cont(v, 0.2) a, quantile_cont(v, 0.4) b, quantile_cont(v, 0.6) c, quantile_cont(v, 0.8) e FROM v WHERE d < DATE '1996-01-01')"


@query(_VOL + " SELECT CASE WHEN v.v <= c.a THEN 1 WHEN v.v <= c.b THEN 2 WHEN v.v <= c.c THEN 3 WHEN v.v <= c.e THEN 4 ELSE 5 END AS quintile, count(*) FILTER (d < DATE '1996-01-01') AS pre, count(*) FILTER (d >= DATE '1996-01-01') AS post, round(avg(r), 8) AS mean FROM v, c WHERE v.v IS NOT NULL AND c.a IS NOT NULL GROUP BY 1", DAILY_SQL)
def volatility_quintiles(spark, sf):
    """Bounds from the days before the cut alone, each the last of its class."""
    v = returns(spark, sf).select("d", "r", rolling(F.stddev_samp, F.col("r"), day(), 5).alias("v"))
    cuts = v.where("d < date'1996-01-01'").agg(F.percentile("v", F.array(*[F.lit(k / 5) for k in range(1, 5)])).alias("c")).where("c is not null")
    quintile = F.when(F.col("v") <= F.col("c")[0], 1).when(F.col("v") <= F.col("c")[1], 2).when(F.col("v") <= F.col("c")[2], 3).when(F.col("v") <= F.col("c")[3], 4).otherwise(5)
    pre = F.col("d") < F.lit("1996-01-01")
    return v.where("v is not null").crossJoin(F.broadcast(cuts)).groupBy(quintile.alias("quintile")).agg(F.count_if(pre).alias("pre"), F.count_if(~pre).alias("post"), r8(F.avg("r")).alias("mean"))


@query(", x AS (SELECT d, r - b AS g, r, b FROM pair), t AS (SELECT d AS top FROM x ORDER BY abs(g) DESC, d LIMIT 1) SELECT t.top, round(product(1 + CASE WHEN x.d = t.top THEN b ELSE r END) - 1, 6) AS replaced, round(product(1 + r) - 1, 6) AS total FROM x, t GROUP BY 1", DAILY_SQL)
def top_day_replaced(spark, sf):
    """The total with the day of the largest difference replaced by the baseline's."""
    x = pair(spark, sf)
    top = x.agg(F.min_by("d", F.struct(-F.abs(F.col("r") - F.col("b")), F.col("d"))).alias("top"))
    return x.crossJoin(F.broadcast(top)).groupBy("top").agg(r8(metrics.total_return(F.when(F.col("d") == F.col("top"), F.col("b")).otherwise(F.col("r"))), 6).alias("replaced"), r8(metrics.total_return(F.col("r")), 6).alias("total"))


@query(" SELECT d, round(r, 8) AS r, round(b, 8) AS b FROM pair ORDER BY greatest(abs(round(r, 8)), abs(round(b, 8))) DESC, d LIMIT 15", DAILY_SQL)
def widest_sessions(spark, sf):
    x = pair(spark, sf).select("d", r8("r").alias("r"), r8("b").alias("b"))
    return x.orderBy(F.greatest(F.abs("r"), F.abs("b")).desc(), "d").limit(15)


@query(", y AS (SELECT year(d)::INT AS y, product(1 + r) - 1 AS r, product(1 + b) - 1 AS b FROM pair GROUP BY 1) SELECT y, round(r, 6) AS strategy, round(b, 4) AS baseline, round(r - b, 4) AS delta, CASE WHEN abs(r - b) <= 0.5 THEN 'close' WHEN r > b THEN 'above' ELSE 'below' END AS reason FROM y", DAILY_SQL)
def annual_comparison(spark, sf):
    y = pair(spark, sf).groupBy(F.year("d").alias("y")).agg(metrics.total_return(F.col("r")).alias("r"), metrics.total_return(F.col("b")).alias("b"))
    gap = F.col("r") - F.col("b")
    return y.select("y", r8("r", 6).alias("strategy"), r8("b", 4).alias("baseline"), r8(gap, 4).alias("delta"), F.when(F.abs(gap) <= 0.5, "close").when(F.col("r") > F.col("b"), "above").otherwise("below").alias("reason"))


_HAC = ", x AS (SELECT d, r - 0.0001 AS e, r, r * r AS q FROM ret WHERE r IS NOT NULL), m AS (SELECT avg(e) me, avg(r) mr, avg(q) mq, stddev_samp(r) sd, count(*) n FROM x), z AS (SELECT e - me AS e, r - mr AS r, q - mq AS q, row_number() OVER (ORDER BY d) AS i FROM x, m), g AS (SELECT *, sqrt(252) / s AS ge, sqrt(252) * me * mr / (s * s * s) AS gr, -sqrt(252) * me / (2 * s * s * s) AS gq FROM (SELECT *, sqrt(mq - mr * mr) AS s FROM m)), p AS (SELECT i, ge * e + gr * r + gq * q AS u FROM z, g), l AS (SELECT u, lag(u, 1) OVER w AS u1, lag(u, 2) OVER w AS u2, lag(u, 3) OVER w AS u3 FROM p WINDOW w AS (ORDER BY i))"


@query(_HAC + " SELECT round(any_value(sqrt(252) * me / sd), 8) AS point, round(sqrt(greatest(sum(u * u) + 2 * (0.75 * sum(u * u1) + 0.5 * sum(u * u2) + 0.25 * sum(u * u3)), 0)) / any_value(n), 8) AS se FROM l, m", DAILY_SQL)
def hac_sharpe(spark, sf):
    """The SQL projects on the gradient first, which has the same variance."""
    return inference.hac_sharpe(_known(spark, sf).select("d", "r", F.lit(0.0001).alias("h")), 3).select(r8("point").alias("point"), r8("se").alias("se"))


def _boot(circular: bool) -> str:
    start = "(rep * 7919 + b * 104729 + 12345) % " + ("s.n" if circular else "greatest(s.n - 19, 1)")
    return f", x AS (SELECT r, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM ret WHERE r IS NOT NULL), s AS (SELECT rep, b, o, n FROM range(40) t(rep), (SELECT DISTINCT n FROM x), range(2000) u(b), range(20) v(o) WHERE b < ceil(n / 20.0) AND b * 20 + o < n), k AS (SELECT rep, sqrt(252) * avg(r - 0.0001) / stddev_samp(r) AS sharpe FROM s JOIN x ON x.i = ({start} + o) % s.n GROUP BY 1)"


_REC = " SELECT round(quantile_cont(sharpe, 0.5), 6) AS median, round(stddev_samp(sharpe), 6) AS sd, round(quantile_cont(sharpe, 0.05), 6) AS low, round(quantile_cont(sharpe, 0.95), 6) AS high, round(avg((sharpe <= 0)::INT), 6) AS not_above_zero FROM k"


def _draws(spark, sf, circular: bool):
    return inference.block_sharpes(_known(spark, sf).select("d", "r", F.lit(0.0001).alias("h")), 40, 20, circular)


@query(_boot(True) + _REC, DAILY_SQL)
def circular_bootstrap_interval(spark, sf):
    rec = inference.percentile_record(_draws(spark, sf, True), "sharpe", 0.9)
    return rec.select(*[r8(c, 6).alias(c) for c in rec.columns])


@query(_boot(False) + _REC, DAILY_SQL)
def moving_bootstrap_interval(spark, sf):
    rec = inference.percentile_record(_draws(spark, sf, False), "sharpe", 0.9)
    return rec.select(*[r8(c, 6).alias(c) for c in rec.columns])


@query(_boot(True) + ", pt AS (SELECT sqrt(252) * avg(r - 0.0001) / stddev_samp(r) AS t FROM x) SELECT round(avg((abs(sharpe - t) >= abs(t))::INT), 6) AS p FROM k, pt", DAILY_SQL)
def centered_p_value(spark, sf):
    point = _known(spark, sf).agg(metrics.sharpe(F.col("r"), 0.0001)).first()[0]
    return inference.centered_p(_draws(spark, sf, True), "sharpe", point or 0.0).select(r8("p", 6).alias("p"))
