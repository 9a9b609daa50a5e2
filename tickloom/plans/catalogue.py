"""The catalogue of queries: Spark plans by name, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import metrics
from tickloom.functions.windows import carried, rolling, run_id, wealth
from tickloom.operators import features as X
from tickloom.operators import inference, sessions
from tickloom.sources.bars import BARS_SQL, DAILY_SQL, HOLED_SQL, bars, benchmark, calendar, daily, grid, holed, table

_Q: dict = {}
_SQL: dict[str, str] = {}


def day():
    return Window.orderBy("d")


def query(sql: str | None = None, base: str = ""):
    """Registers a plan and, given its body, the SQL over the derived views."""

    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = (f"WITH {base.strip()}" if base else "") + sql
        return f

    return add


def r8(c, n: int = 8):
    return F.round(c, n)


def returns(spark, sf) -> DataFrame:
    d = daily(spark, sf)
    return d.withColumn("r", F.try_divide("close", F.lag("close").over(day())) - 1)


def pair(spark, sf) -> DataFrame:
    b = benchmark(spark, sf).select("d", (F.try_divide("close", F.lag("close").over(day())) - 1).alias("b"))
    return returns(spark, sf).join(b, "d").where("r is not null and b is not null").select("d", "r", "b")


_FEATURES = """, f1 AS (
  SELECT *, first(open ORDER BY m) FILTER (open IS NOT NULL) OVER (PARTITION BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x0,
    sum(volume * (high + low + close) / 3) OVER s / nullif(sum(CASE WHEN close IS NOT NULL THEN volume END) OVER s, 0) AS v FROM grid WINDOW s AS (PARTITION BY d ORDER BY m ROWS UNBOUNDED PRECEDING)
), o AS (SELECT d, arg_min(open, m) FILTER (open IS NOT NULL) AS day_open, arg_max(close, m) FILTER (close IS NOT NULL) AS last_close FROM grid GROUP BY 1
), o2 AS (SELECT d, day_open, lag(last_close) OVER (ORDER BY d) AS prev_close FROM o
), f2 AS (SELECT f1.d, f1.m, f1.open, f1.close, CASE WHEN f1.close IS NOT NULL THEN v END AS vwap, o2.day_open, o2.prev_close, abs(f1.close / o2.day_open - 1) AS move FROM f1 JOIN o2 ON f1.d = o2.d
), f3 AS (SELECT *, CASE WHEN count(move) OVER h >= 3 THEN avg(move) OVER h END AS sigma, count(move) OVER h AS history FROM f2 WINDOW h AS (PARTITION BY m ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
), f4 AS (SELECT *, CASE WHEN prev_close IS NOT NULL THEN greatest(day_open, prev_close) ELSE day_open END * (1 + sigma) AS upper, CASE WHEN prev_close IS NOT NULL THEN least(day_open, prev_close) ELSE day_open END * (1 - sigma) AS lower FROM f3
), f5 AS (SELECT *, CASE WHEN m % 3 = 0 AND sigma IS NOT NULL AND prev_close IS NOT NULL AND close IS NOT NULL THEN CASE WHEN close > upper AND close > vwap THEN 1 WHEN close < lower AND close < vwap THEN -1 ELSE 0 END END AS signal,
  CASE WHEN m % 3 = 0 AND sigma IS NOT NULL AND prev_close IS NOT NULL AND close IS NOT NULL THEN CASE WHEN close > upper THEN 1 WHEN close < lower THEN -1 ELSE 0 END END AS plain FROM f4)"""
_FEATURES = _FEATURES.replace("first(open ORDER BY m) FILTER (open IS NOT NULL) OVER (PARTITION BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x0,\n    ", "")
FB = BARS_SQL + _FEATURES


@query(" SELECT d, m, round(vwap, 8) AS vwap, round(sigma, 8) AS sigma, round(upper, 8) AS upper, round(lower, 8) AS lower, signal FROM f5", FB)
def signal_band_vwap(spark, sf):
    return X.features(grid(spark, sf)).select("d", "m", r8("vwap").alias("vwap"), r8("sigma").alias("sigma"), r8("upper").alias("upper"), r8("lower").alias("lower"), "signal")


@query(" SELECT d, m, plain AS signal FROM f5 WHERE plain IS NOT NULL", FB)
def signal_no_vwap(spark, sf):
    return X.features(grid(spark, sf), confirm=False).where("signal is not null").select("d", "m", "signal")


@query(" SELECT d, m, coalesce(last_value(CASE WHEN plain <> 0 THEN plain END IGNORE NULLS) OVER (PARTITION BY d ORDER BY m ROWS UNBOUNDED PRECEDING), 0) AS position FROM f5", FB)
def signal_naive_latch(spark, sf):
    s = X.features(grid(spark, sf), confirm=False)
    return s.select("d", "m", F.coalesce(carried(F.when(F.col("signal") != 0, F.col("signal")), X.session()), F.lit(0)).alias("position"))


@query(""", p AS (SELECT *, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY d ORDER BY m ROWS UNBOUNDED PRECEDING), 0) AS position FROM f5),
 e AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY d ORDER BY m), 0) AS exposure, close - lag(close) OVER (PARTITION BY d ORDER BY m) AS dc FROM p)
 SELECT d, round(sum(exposure * dc), 6) AS gross, sum(abs(exposure - prev)) AS turned FROM (SELECT *, coalesce(lag(exposure) OVER (PARTITION BY d ORDER BY m), 0) AS prev FROM e) GROUP BY 1""", FB)
def notebook_exposure_pnl(spark, sf):
    e = X.exposure(X.features(grid(spark, sf)))
    e = e.withColumn("prev", F.coalesce(F.lag("exposure").over(X.session()), F.lit(0)))
    return e.groupBy("d").agg(r8(F.sum("pnl"), 6).alias("gross"), F.sum(F.abs(F.col("exposure") - F.col("prev"))).alias("turned"))


@query(" SELECT d, m, round(sum(volume * (open + high + low + close) / 4) OVER s / sum(CASE WHEN close IS NOT NULL THEN volume END) OVER s, 8) AS vwap FROM grid WINDOW s AS (PARTITION BY d ORDER BY m ROWS UNBOUNDED PRECEDING) QUALIFY close IS NOT NULL", BARS_SQL)
def vwap_cumulative_ohlc4(spark, sf):
    return X.with_vwap(grid(spark, sf), "ohlc4").where("close is not null").select("d", "m", r8("vwap").alias("vwap"))


@query(" SELECT d, m, round(sum(CASE WHEN m BETWEEN 6 AND 8 THEN 0 ELSE volume END * (high + low + close) / 3) OVER s / nullif(sum(CASE WHEN close IS NULL THEN 0 WHEN m BETWEEN 6 AND 8 THEN 0 ELSE volume END) OVER s, 0), 8) AS vwap FROM grid WINDOW s AS (PARTITION BY d ORDER BY m ROWS UNBOUNDED PRECEDING) QUALIFY close IS NOT NULL", BARS_SQL)
def vwap_cumulative_halt_masked(spark, sf):
    return X.with_vwap(grid(spark, sf), "hlc3", F.col("m").between(6, 8)).where("close is not null").select("d", "m", r8("vwap").alias("vwap"))


@query(" SELECT d, m, round(sigma, 8) AS sigma, history FROM f3", FB)
def sigma_open_strict(spark, sf):
    return X.with_sigma(X.with_move(grid(spark, sf))).select("d", "m", r8("sigma").alias("sigma"), "history")


@query(" SELECT d, m, round(CASE WHEN count(*) OVER h >= 3 THEN avg(move) OVER h END, 8) AS sigma FROM f2 WHERE move IS NOT NULL WINDOW h AS (PARTITION BY m ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", FB)
def sigma_open_loose(spark, sf):
    g = X.with_move(grid(spark, sf)).where("move is not null")
    return X.with_sigma(g).select("d", "m", r8("sigma").alias("sigma"))


@query(" SELECT d, count(close) AS observed, count(*) - count(close) AS missing, min(m) FILTER (close IS NOT NULL) AS first_m, max(m) FILTER (close IS NOT NULL) AS last_m FROM grid GROUP BY 1", HOLED_SQL)
def session_minute_sets(spark, sf):
    seen = F.col("close").isNotNull()
    return grid(spark, sf, holed).groupBy("d").agg(F.count("close").alias("observed"), F.count_if(~seen).alias("missing"), F.min(F.when(seen, F.col("m"))).alias("first_m"), F.max(F.when(seen, F.col("m"))).alias("last_m"))


@query(""", b AS (SELECT d, min(m) a, max(m) z FROM bars GROUP BY 1)
 SELECT g.d, count(*) FILTER (close IS NULL AND m < a) AS leading, count(*) FILTER (close IS NULL AND m > a AND m < z) AS interior, count(*) FILTER (close IS NULL AND m > z) AS trailing FROM grid g JOIN b ON g.d = b.d GROUP BY 1""", HOLED_SQL)
def missing_positions_pivot(spark, sf):
    g = grid(spark, sf, holed)
    w = Window.partitionBy("d")
    seen = F.when(F.col("close").isNotNull(), F.col("m"))
    g = g.withColumn("a", F.min(seen).over(w)).withColumn("z", F.max(seen).over(w)).where("close is null")
    kind = F.when(F.col("m") < F.col("a"), "leading").when(F.col("m") > F.col("z"), "trailing").otherwise("interior")
    counts = g.withColumn("kind", kind).groupBy("d").pivot("kind", ["leading", "interior", "trailing"]).count()
    return holed(spark, sf).select("d").distinct().join(counts, "d", "left").fillna(0, ["leading", "interior", "trailing"])


HALTS = [(0, 5, 9), (0, 8, 11), (3, 20, 30), (4, -2, 1)]
_HALTS_SQL = """h AS (SELECT DISTINCT d, m FROM (SELECT c.d, unnest(range(a, b + 1))::INT AS m FROM cal c JOIN (VALUES (0, 5, 9), (0, 8, 11), (3, 20, 30), (4, -2, 1)) t(k, a, b) ON c.n % 7 = k) WHERE m BETWEEN 1 AND 24)"""
_DIAGNOSED = (
    """, cal AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS n FROM (SELECT DISTINCT d FROM grid)), """
    + _HALTS_SQL
    + """, o AS (SELECT d, m, sum(volume) AS volume FROM bars GROUP BY 1, 2), g AS (
  SELECT g.d, g.m, o.m IS NOT NULL AS observed, h.m IS NOT NULL AS halt, volume FROM (SELECT d, m FROM grid) g LEFT JOIN o ON o.d = g.d AND o.m = g.m LEFT JOIN h ON h.d = g.d AND h.m = g.m
), g2 AS (SELECT *, min(CASE WHEN observed THEN m END) OVER (PARTITION BY d) AS a, max(CASE WHEN observed THEN m END) OVER (PARTITION BY d) AS z FROM g
), s AS (SELECT d, count(*) FILTER (halt) AS halted, count(*) FILTER (NOT halt) AS required, count(*) FILTER (observed) AS observed, count(*) FILTER (NOT halt AND NOT observed) AS missing, count(*) FILTER (halt AND observed) AS present_in_halt,
  count(*) FILTER (NOT halt AND NOT observed AND (a IS NULL OR m < a)) AS "leading", count(*) FILTER (NOT halt AND NOT observed AND m > a AND m < z) AS interior, count(*) FILTER (NOT halt AND NOT observed AND m > z) AS "trailing", coalesce(sum(volume), 0)::BIGINT AS volume FROM g2 GROUP BY 1)"""
)


def halted(spark, sf) -> DataFrame:
    """(d, m) of halted minutes: windows that overlap and reach out of the session, on some days of the calendar."""
    n = calendar(spark, sf).select("d", (F.row_number().over(day()) - 1).alias("n"))
    h = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, HALTS)) + " AS t(k, a, b)")
    opens = F.col("d").cast("timestamp")
    at = lambda c: opens + F.make_dt_interval(mins=F.col(c) - 1)
    windows = n.join(F.broadcast(h), F.col("n") % 7 == F.col("k")).select("d", at("a").alias("starts"), at("b").alias("ends"))
    return sessions.halt_minutes(calendar(spark, sf).select("d", opens.alias("opens"), F.lit(24).alias("bars")), windows)


def diagnosed(spark, sf) -> DataFrame:
    return sessions.diagnostics(holed(spark, sf).select("d", "m", "volume"), calendar(spark, sf).withColumn("bars", F.lit(24)), halted(spark, sf))


@query(_DIAGNOSED + ' SELECT d, halted, required, observed, missing, present_in_halt, "leading", interior, "trailing", volume FROM s', HOLED_SQL)
def session_diagnostics(spark, sf):
    return diagnosed(spark, sf).select("d", "halted", "required", "observed", "missing", "present_in_halt", "leading", "interior", "trailing", "volume")


@query(_DIAGNOSED + """, q AS (SELECT *, CASE WHEN observed = 0 THEN 'absent' WHEN missing = 0 AND halted > 0 THEN 'halt_adjusted' WHEN missing = 0 THEN 'complete' WHEN observed < 0.5 * required THEN 'sparse' WHEN "leading" + "trailing" >= interior THEN 'truncated' ELSE 'interior_gap' END AS quality FROM s)
 SELECT d, quality, quality = 'complete' AS paper_ready, quality IN ('complete', 'halt_adjusted') AS halt_usable, quality NOT IN ('absent', 'sparse') AS exploratory FROM q""", HOLED_SQL)
def session_grading(spark, sf):
    """Bars in a halt are let pass here."""
    return sessions.graded(diagnosed(spark, sf), "present").select("d", "quality", "paper_ready", "halt_usable", "exploratory")


@query(_DIAGNOSED + """, q AS (SELECT CASE WHEN observed = 0 THEN 'absent' WHEN halted > 0 AND present_in_halt > 0 THEN 'halt_anomaly' WHEN missing = 0 AND halted > 0 THEN 'halt_adjusted' WHEN missing = 0 THEN 'complete' WHEN observed < 0.5 * required THEN 'sparse' WHEN "leading" + "trailing" >= interior THEN 'truncated' ELSE 'interior_gap' END AS quality FROM s)
 SELECT k AS quality, count(q.quality) AS n FROM (VALUES ('complete'), ('halt_adjusted'), ('interior_gap'), ('truncated'), ('sparse'), ('halt_anomaly'), ('absent')) t(k) LEFT JOIN q ON q.quality = k GROUP BY 1""", HOLED_SQL)
def quality_counts(spark, sf):
    """Every grade, those of no session too."""
    names = spark.sql("SELECT explode(array('complete', 'halt_adjusted', 'interior_gap', 'truncated', 'sparse', 'halt_anomaly', 'absent')) AS quality")
    counts = sessions.graded(diagnosed(spark, sf)).groupBy("quality").agg(F.count("*").alias("n"))
    return names.join(counts, "quality", "left").fillna(0, ["n"])


@query(" SELECT d, m, sum((close IS NULL)::INT) OVER (PARTITION BY d ORDER BY m ROWS UNBOUNDED PRECEDING) = 0 AS vwap_valid, coalesce(sum((close IS NOT NULL)::INT) OVER (PARTITION BY m ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) >= 5 AS history_valid FROM grid", HOLED_SQL)
def component_validity(spark, sf):
    gone, here = F.col("close").isNull().cast("int"), F.col("close").isNotNull().cast("int")
    return grid(spark, sf, holed).select("d", "m", (F.sum(gone).over(X.session().rowsBetween(Window.unboundedPreceding, 0)) == 0).alias("vwap_valid"), (F.coalesce(F.sum(here).over(X.minute().rowsBetween(-5, -1)), F.lit(0)) >= 5).alias("history_valid"))


@query(""", c AS (SELECT *, last_value(close IGNORE NULLS) OVER p AS pc, last_value(CASE WHEN close IS NOT NULL THEN m END IGNORE NULLS) OVER p AS pm FROM grid WINDOW p AS (PARTITION BY d ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT d, m, CASE WHEN m = 9 THEN 'halt_reopen' WHEN m - pm = 1 THEN 'continuous' ELSE 'gap' END AS kind, round(close / pc - 1, 8) AS r FROM c WHERE close IS NOT NULL AND pc IS NOT NULL""", BARS_SQL)
def return_classification(spark, sf):
    g = grid(spark, sf).withColumn("pc", carried(F.col("close"), X.session(), -1)).withColumn("pm", carried(F.when(F.col("close").isNotNull(), F.col("m")), X.session(), -1))
    kind = F.when(F.col("m") == 9, "halt_reopen").when(F.col("m") - F.col("pm") == 1, "continuous").otherwise("gap")
    return g.where("close is not null and pc is not null").select("d", "m", kind.alias("kind"), r8(F.try_divide("close", "pc") - 1).alias("r"))


@query(""", c AS (SELECT d, m, close / lag(close) OVER (PARTITION BY d ORDER BY m) - 1 AS r FROM bars) SELECT d, m, round(r, 8) AS r FROM c WHERE r IS NOT NULL ORDER BY abs(round(r, 8)) DESC, d, m LIMIT 15""", BARS_SQL)
def extreme_returns_topk(spark, sf):
    b = bars(spark, sf).select("d", "m", r8(F.try_divide("close", F.lag("close").over(X.session())) - 1).alias("r"))
    return b.where("r is not null").orderBy(F.abs("r").desc(), "d", "m").limit(15)


@query(""", t AS (SELECT *, open = high AND high = low AND low = close AS up FROM bars), q AS (SELECT *, sum((up <> lag_up OR lag_up IS NULL OR m - lag_m > 1)::INT) OVER (PARTITION BY d ORDER BY m) AS run FROM (SELECT *, lag(up) OVER w AS lag_up, lag(m) OVER w AS lag_m FROM t WINDOW w AS (PARTITION BY d ORDER BY m)))
 SELECT d, min(m) AS first_m, max(m) AS last_m, count(*) AS n FROM q WHERE up GROUP BY d, run ORDER BY n DESC, d, first_m LIMIT 500""", HOLED_SQL)
def stale_runs_topk(spark, sf):
    b = holed(spark, sf).withColumn("up", (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close")))
    breaks = (F.col("up") != F.lag("up").over(X.session())) | F.lag("up").over(X.session()).isNull() | (F.col("m") - F.lag("m").over(X.session()) > 1)
    b = b.withColumn("breaks", breaks).withColumn("run", run_id(F.col("breaks"), X.session()))
    return b.where("up").groupBy("d", "run").agg(F.min("m").alias("first_m"), F.max("m").alias("last_m"), F.count("*").alias("n")).drop("run").orderBy(F.desc("n"), "d", "first_m").limit(500)


@query(" SELECT DISTINCT m::INT AS m FROM (SELECT unnest(range(a, b + 1)) AS m FROM (VALUES (3, 9), (6, 15), (22, 30)) t(a, b)) WHERE m BETWEEN 1 AND 24")
def halt_union_minutes(spark, sf):
    h = spark.sql("SELECT * FROM VALUES (3, 9), (6, 15), (22, 30) AS t(a, b)")
    return h.select(F.explode(F.sequence("a", "b")).alias("m")).where(F.col("m").between(1, 24)).distinct()


@query(" SELECT count(*) AS n, count(*) FILTER (NOT (open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close, low) AND low <= least(open, close, high) AND volume >= 0)) AS invalid FROM bars", BARS_SQL)
def ohlc_validity(spark, sf):
    ok = (F.least("open", "high", "low", "close") > 0) & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high")) & (F.col("volume") >= 0)
    return bars(spark, sf).agg(F.count("*").alias("n"), F.count_if(~ok).alias("invalid"))


@query(" SELECT user_id, count(*) AS n, count(try_cast(CASE WHEN event_type = 'click' THEN value::VARCHAR ELSE event_type END AS DOUBLE)) AS numeric FROM events GROUP BY 1")
def numeric_cast_bad_rows(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.expr("try_cast(if(event_type = 'click', string(value), event_type) as double)")).alias("numeric"))


@query(", e AS (SELECT *, 1 AS pos FROM events UNION ALL SELECT event_id, ts, user_id, event_type, value + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, props, 2 FROM events WHERE event_id % 5 = 0) SELECT count(*) AS keys, sum((n > 1)::INT)::BIGINT AS repeated, sum((v > 1)::INT)::BIGINT AS conflicting FROM (SELECT event_id, count(*) n, count(DISTINCT value) v FROM e GROUP BY 1)".replace(", e AS", "WITH e AS", 1))
def dedupe_conflicts(spark, sf):
    return _repeated(spark, sf).groupBy("event_id").agg(F.count("*").alias("n"), F.count_distinct("value").alias("v")).agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("v") > 1).alias("conflicting"))


def _repeated(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    again = e.where("event_id % 5 = 0").select("event_id", (F.col("value") + F.when(F.col("event_id") % 10 == 0, 1.0).otherwise(0.0)).alias("value"))
    return e.withColumn("pos", F.lit(1)).unionByName(again.withColumn("pos", F.lit(2)))


@query("WITH e AS (SELECT event_id, value, 1 AS pos FROM events UNION ALL SELECT event_id, value + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, 2 FROM events WHERE event_id % 5 = 0) SELECT event_id, arg_max(value, pos) AS value, max(pos) AS pos FROM e GROUP BY 1")
def dedupe_precedence(spark, sf):
    """The last source wins; a maximum by position needs one row a key and task, not a sort."""
    return _repeated(spark, sf).groupBy("event_id").agg(F.max_by("value", "pos").alias("value"), F.max("pos").alias("pos"))


@query(", c AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders), r AS (SELECT d AS rate_d FROM daily WHERE day(d) % 3 = 0) SELECT c.o_orderkey, c.d, rate_d FROM c ASOF LEFT JOIN r ON c.d > r.rate_d", DAILY_SQL)
def asof_strict_rate(spark, sf):
    """The latest observation strictly before: facts and observations are merged by date, one carry over days, not over facts."""
    d = daily(spark, sf)
    facts = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    days = d.select("d", F.max(F.when(F.dayofmonth("d") % 3 == 0, F.col("d"))).over(day().rowsBetween(Window.unboundedPreceding, -1)).alias("rate_d"))
    return facts.join(days, "d", "left").select("o_orderkey", "d", "rate_d")


_FEES = [("1990-01-01", "1996-12-31", 15.3), ("1997-01-01", "1999-06-30", 5.6), ("1999-07-01", None, 20.6)]


@query("WITH f(a, b, rate) AS (VALUES (DATE '1990-01-01', DATE '1996-12-31', 15.3), (DATE '1997-01-01', DATE '1999-06-30', 5.6), (DATE '1999-07-01', NULL, 20.6)) SELECT rate::DOUBLE AS rate, count(*) AS n, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE * rate::DOUBLE / 1e6, 4) AS fee FROM orders JOIN f ON o_orderdate::DATE BETWEEN a AND coalesce(b, DATE '9999-12-31') GROUP BY rate")
def interval_fee_rate(spark, sf):
    """An interval join: the schedule is a fixed short table, so it is sent to the facts."""
    fees = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', {repr(b) if b else 'NULL'}, {x}d)" for a, b, x in _FEES) + " AS t(a, b, rate)").select(F.to_date("a").alias("a"), F.coalesce(F.to_date("b"), F.lit("9999-12-31").cast("date")).alias("b"), "rate")
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), "o_totalprice")
    return o.join(F.broadcast(fees), F.col("d").between(F.col("a"), F.col("b"))).groupBy("rate").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s")).select("rate", "n", F.round(F.col("s").cast("double") * F.col("rate") / 1e6, 4).alias("fee"))


@query(" SELECT d.d, round(avg(p.close), 6) AS prior_month FROM daily d JOIN daily p ON date_trunc('month', p.d) = date_trunc('month', d.d) - INTERVAL 1 MONTH GROUP BY d.d", DAILY_SQL)
def prior_month_rate(spark, sf):
    d = daily(spark, sf)
    months = d.groupBy(F.add_months(F.trunc("d", "MM"), 1).alias("month")).agg(r8(F.avg("close"), 6).alias("prior_month"))
    return d.withColumn("month", F.trunc("d", "MM")).join(months, "month").select("d", "prior_month")


@query(" SELECT 'missing' AS side, count(*) AS n FROM daily d WHERE NOT EXISTS (SELECT 1 FROM daily2 b WHERE b.d = d.d) UNION ALL SELECT 'extra', count(*) FROM daily2 b WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE b.d = d.d)", DAILY_SQL)
def calendar_anti_join(spark, sf):
    a, b = daily(spark, sf), benchmark(spark, sf)
    n = F.count("*").alias("n")
    return a.join(b, "d", "left_anti").agg(n).select(F.lit("missing").alias("side"), "n").unionByName(b.join(a, "d", "left_anti").agg(n).select(F.lit("extra").alias("side"), "n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1")
def key_semi_join(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 200000").select("o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(", u AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders) SELECT count(*) AS n, count(DISTINCT d) AS days, (SELECT max(gap) FROM (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS gap FROM daily)) AS longest_gap FROM u", DAILY_SQL)
def session_coverage(spark, sf):
    d = daily(spark, sf).select("d", F.datediff("d", F.lag("d").over(day())).alias("gap")).agg(F.count("*").alias("days"), F.max("gap").cast("long").alias("longest_gap"))
    return table(spark, sf, "orders").agg(F.count("*").alias("n")).crossJoin(d)


@query(" SELECT d, round(CASE WHEN count(r) OVER h = 5 THEN stddev_samp(r) OVER h END, 8) AS vol FROM ret WINDOW h AS (ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", DAILY_SQL)
def daily_vol_lag1(spark, sf):
    return returns(spark, sf).select("d", r8(rolling(F.stddev_samp, F.col("r"), day(), 5, 1)).alias("vol"))


@query(" SELECT d, round(CASE WHEN count(r) OVER h = 5 THEN stddev_samp(r) OVER h END, 8) AS vol FROM ret WINDOW h AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING)", DAILY_SQL)
def daily_vol_lag2(spark, sf):
    return returns(spark, sf).select("d", r8(rolling(F.stddev_samp, F.col("r"), day(), 5, 2)).alias("vol"))


@query(", w AS (SELECT d, product(1 + coalesce(r, 0)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS w FROM ret) SELECT d, round(w, 6) AS wealth, round(w / max(w) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM w", DAILY_SQL)
def drawdown_curve(spark, sf):
    w = returns(spark, sf).select("d", wealth(F.col("r"), day()).alias("w"))
    return w.select("d", r8("w", 6).alias("wealth"), r8(F.col("w") / F.max("w").over(day().rowsBetween(Window.unboundedPreceding, 0)) - 1, 6).alias("drawdown"))


@query(" SELECT count(r) AS n, round(avg(r), 8) AS mean, round(stddev_samp(r) * sqrt(252), 8) AS vol, round(avg(r) / stddev_samp(r) * sqrt(252), 8) AS sharpe, round(skewness(r), 6) AS skew, round(min(r), 8) AS worst, round(avg((r > 0)::INT) FILTER (r <> 0), 8) AS hit FROM ret", DAILY_SQL)
def perf_summary(spark, sf):
    r = F.col("r")
    return returns(spark, sf).agg(F.count(r).alias("n"), r8(F.avg(r)).alias("mean"), r8(F.stddev_samp(r) * F.sqrt(F.lit(252.0))).alias("vol"), r8(metrics.sharpe(r)).alias("sharpe"), r8(metrics.skew(r), 6).alias("skew"), r8(F.min(r)).alias("worst"), r8(F.avg(F.when(r != 0, (r > 0).cast("int")))).alias("hit"))


@query(", p AS (SELECT *, CASE WHEN d < DATE '1998-01-01' THEN 'pre' ELSE 'post' END AS period FROM ret WHERE r IS NOT NULL) SELECT period, count(*) AS n, round(product(1 + r) - 1, 6) AS total, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM (SELECT * FROM p UNION ALL SELECT d, close, r, 'full' FROM p) GROUP BY 1", DAILY_SQL)
def period_performance(spark, sf):
    r = returns(spark, sf).where("r is not null").withColumn("period", F.explode(F.array(F.lit("full"), F.when(F.col("d") < "1998-01-01", "pre").otherwise("post"))))
    return r.groupBy("period").agg(F.count("*").alias("n"), r8(metrics.total_return(F.col("r")), 6).alias("total"), r8(metrics.sharpe(F.col("r")), 6).alias("sharpe"))


@query(" SELECT round(covar_samp(r, b) / var_pop(b), 8) AS beta, round((avg(r) - covar_samp(r, b) / var_pop(b) * avg(b)) * 252, 8) AS alpha, round(avg(r - b) / stddev_samp(r - b) * sqrt(252), 8) AS information, round(regr_slope(r, b), 8) AS slope, round(regr_intercept(r, b), 8) AS intercept, round(regr_r2(r, b), 8) AS r2 FROM pair", DAILY_SQL)
def beta_alpha_ir(spark, sf):
    r, b = F.col("r"), F.col("b")
    beta = metrics.beta(r, b)
    return pair(spark, sf).agg(r8(beta).alias("beta"), r8((F.avg(r) - beta * F.avg(b)) * 252).alias("alpha"), r8(metrics.sharpe(r - b)).alias("information"), r8(F.regr_slope(r, b)).alias("slope"), r8(F.regr_intercept(r, b)).alias("intercept"), r8(F.regr_r2(r, b)).alias("r2"))


@query(", m AS (SELECT year(d)::INT AS y, month(d) AS mo, product(1 + r) - 1 AS t FROM ret WHERE r IS NOT NULL GROUP BY 1, 2) SELECT y, round(max(t) FILTER (mo = 1), 6) AS m1, round(max(t) FILTER (mo = 2), 6) AS m2, round(max(t) FILTER (mo = 3), 6) AS m3, round(max(t) FILTER (mo = 4), 6) AS m4, round(max(t) FILTER (mo = 5), 6) AS m5, round(max(t) FILTER (mo = 6), 6) AS m6, round(max(t) FILTER (mo = 7), 6) AS m7, round(max(t) FILTER (mo = 8), 6) AS m8, round(max(t) FILTER (mo = 9), 6) AS m9, round(max(t) FILTER (mo = 10), 6) AS m10, round(max(t) FILTER (mo = 11), 6) AS m11, round(max(t) FILTER (mo = 12), 6) AS m12, round(product(1 + t) - 1, 6) AS yearly FROM m GROUP BY 1", DAILY_SQL)
def monthly_pivot(spark, sf):
    m = returns(spark, sf).where("r is not null").groupBy(F.year("d").alias("y"), F.month("d").alias("mo")).agg(metrics.total_return(F.col("r")).alias("t"))
    wide = m.groupBy("y").pivot("mo", list(range(1, 13))).agg(F.max("t"))
    return wide.join(m.groupBy("y").agg(metrics.total_return(F.col("t")).alias("yearly")), "y").select("y", *[r8(F.col(str(k)), 6).alias(f"m{k}") for k in range(1, 13)], r8("yearly", 6).alias("yearly"))


@query(" SELECT date_trunc('month', d)::DATE AS month, arg_max(close, d) AS close FROM daily GROUP BY 1", DAILY_SQL)
def month_end_equity(spark, sf):
    return daily(spark, sf).groupBy(F.trunc("d", "MM").alias("month")).agg(F.max_by("close", "d").alias("close"))


@query(", x AS (SELECT *, row_number() OVER (ORDER BY d) AS n FROM pair) SELECT d, round(corr(r, b) OVER h, 6) AS corr FROM x WINDOW h AS (ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) QUALIFY n >= 63", DAILY_SQL)
def rolling_corr_63(spark, sf):
    w = day().rowsBetween(-62, 0)
    return pair(spark, sf).select("d", F.when(F.count("r").over(w) >= 63, r8(F.corr("r", "b").over(w), 6)).alias("corr")).where("corr is not null")


@query(", m AS (SELECT date_trunc('month', d) AS mo, product(1 + r) - 1 AS r, product(1 + b) - 1 AS b FROM pair GROUP BY 1), k AS (SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS kr, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS kb FROM m) SELECT count(*) AS n, round(corr(kr, kb), 6) AS spearman FROM k", DAILY_SQL)
def spearman_monthly(spark, sf):
    m = pair(spark, sf).groupBy(F.trunc("d", "MM").alias("mo")).agg(metrics.total_return(F.col("r")).alias("r"), metrics.total_return(F.col("b")).alias("b"))
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    return m.select(rank("r").alias("kr"), rank("b").alias("kb")).agg(F.count("*").alias("n"), r8(F.corr("kr", "kb"), 6).alias("spearman"))


@query(" SELECT round(avg(r) FILTER (b > 0) / avg(b) FILTER (b > 0), 6) AS up, round(avg(r) FILTER (b < 0) / avg(b) FILTER (b < 0), 6) AS down FROM pair", DAILY_SQL)
def capture_ratios(spark, sf):
    on = lambda c, ok: F.avg(F.when(ok, F.col(c)))
    return pair(spark, sf).agg(*[r8(F.try_divide(on("r", ok), on("b", ok)), 6).alias(name) for name, ok in (("up", F.col("b") > 0), ("down", F.col("b") < 0))])


@query(", p AS (SELECT r FROM ret WHERE r > 0) SELECT round(1 / sum((r / t) * (r / t)), 6) AS effective_days FROM p CROSS JOIN (SELECT sum(r) AS t FROM p)", DAILY_SQL)
def profit_concentration(spark, sf):
    return returns(spark, sf).where("r > 0").agg(r8(F.try_divide(F.pow(F.sum("r"), F.lit(2)), F.sum(F.pow("r", F.lit(2)))), 6).alias("effective_days"))


@query(", k AS (SELECT r, row_number() OVER (ORDER BY r DESC, d) AS n FROM ret WHERE r IS NOT NULL) SELECT k.k::INT AS k, round(product(1 + CASE WHEN n <= k.k THEN 0 ELSE r END) - 1, 6) AS without FROM k CROSS JOIN (VALUES (1), (5), (10), (20)) k(k) GROUP BY 1", DAILY_SQL)
def best_days_removed(spark, sf):
    """Only the few best days are ranked, by a top-k; all days are multiplied once for each k, the best ones as 1."""
    r = returns(spark, sf).where("r is not null")
    best = r.orderBy(F.desc("r"), "d").limit(20).select("d", F.row_number().over(Window.orderBy(F.desc("r"), "d")).alias("n"))
    ks = spark.sql("SELECT explode(array(1, 5, 10, 20)) AS k")
    all_ = r.join(F.broadcast(best), "d", "left").crossJoin(F.broadcast(ks))
    return all_.groupBy("k").agg(r8(metrics.total_return(F.when(F.col("n") <= F.col("k"), 0.0).otherwise(F.col("r"))), 6).alias("without"))


@query(", q AS (SELECT date_trunc('quarter', d)::DATE AS q, product(1 + r) - 1 AS t, count(*) AS n FROM ret WHERE r IS NOT NULL GROUP BY 1) SELECT q, round(t, 6) AS t FROM q WHERE n >= 20 ORDER BY t, q LIMIT 5", DAILY_SQL)
def worst_quarters(spark, sf):
    q = returns(spark, sf).where("r is not null").groupBy(F.date_trunc("quarter", "d").cast("date").alias("q")).agg(metrics.total_return(F.col("r")).alias("t"), F.count("*").alias("n"))
    return q.where("n >= 20").orderBy("t", "q").limit(5).select("q", r8("t", 6).alias("t"))


@query(", x AS (SELECT d, r, r * 0.75 AS a, r * 0.25 AS c FROM ret WHERE r IS NOT NULL), y AS (SELECT *, coalesce(product(1 + r) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS later FROM x) SELECT year(d)::INT AS y, round(sum(a * later), 4) AS long_part, round(sum(c * later), 4) AS short_part FROM y GROUP BY 1", DAILY_SQL)
def linked_contribution(spark, sf):
    """Each part of a day's return times the growth of all days after it; parts add up to the total return."""
    x = returns(spark, sf).where("r is not null").withColumn("later", F.coalesce(F.product(1 + F.col("r")).over(day().rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0)))
    return x.groupBy(F.year("d").alias("y")).agg(r8(F.sum(F.col("r") * 0.75 * F.col("later")), 4).alias("long_part"), r8(F.sum(F.col("r") * 0.25 * F.col("later")), 4).alias("short_part"))


@query(", t AS (SELECT d, count(close) AS n, avg(close) AS twap, min(close) AS lo, max(close) AS hi FROM grid WHERE m > 19 GROUP BY 1) SELECT t.d, round(twap, 8) AS twap, lo, hi, round(z.close - twap, 8) AS diff FROM t JOIN (SELECT d, arg_max(close, m) AS close FROM bars GROUP BY 1) z ON t.d = z.d WHERE n = 5", BARS_SQL)
def tail_twap(spark, sf):
    t = grid(spark, sf).groupBy("d").agg(*[f(F.when(F.col("m") > 19, F.col("close"))).alias(n) for f, n in ((F.count, "n"), (F.avg, "twap"), (F.min, "lo"), (F.max, "hi"))], F.max_by("close", F.when(F.col("close").isNotNull(), F.col("m"))).alias("close"))
    return t.where("n = 5").select("d", r8("twap").alias("twap"), "lo", "hi", r8(F.col("close") - F.col("twap")).alias("diff"))


@query(" SELECT count(*) AS n, round(avg(abs(r - b)), 8) AS mae, round(quantile_cont(abs(r - b), 0.5), 8) AS median, round(quantile_cont(abs(r - b), 0.95), 8) AS p95, round(max(abs(r - b)), 8) AS most, count(*) FILTER (abs(r - b) > 0.1) AS over FROM pair", DAILY_SQL)
def source_difference_diag(spark, sf):
    x = F.abs(F.col("r") - F.col("b"))
    return pair(spark, sf).agg(F.count("*").alias("n"), r8(F.avg(x)).alias("mae"), r8(F.percentile(x, 0.5)).alias("median"), r8(F.percentile(x, 0.95)).alias("p95"), r8(F.max(x)).alias("most"), F.count_if(x > 0.1).alias("over"))


@query(", y AS (SELECT DISTINCT year(d)::INT AS y FROM ret) SELECT y.y, count(r) AS n, round(product(1 + r) - 1, 6) AS total FROM y JOIN ret ON year(ret.d) >= y.y WHERE r IS NOT NULL GROUP BY 1", DAILY_SQL)
def start_year_sensitivity(spark, sf):
    """Totals from each start year on: years are summed once, then summed backwards."""
    y = returns(spark, sf).where("r is not null").groupBy(F.year("d").alias("y")).agg(F.count("r").alias("n"), F.product(1 + F.col("r")).alias("t"))
    w = Window.orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, 0)
    return y.select("y", F.sum("n").over(w).alias("n"), r8(F.product("t").over(w) - 1, 6).alias("total"))


@query(", v AS (SELECT d, r, CASE WHEN count(r) OVER h = 5 THEN least(0.2 / (stddev_samp(r) OVER h), 4) END AS lev FROM ret WINDOW h AS (ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT CASE WHEN lev < 1 THEN 'low' WHEN lev < 2 THEN 'mid' ELSE 'high' END AS band, count(*) AS n, round(avg(lev), 6) AS mean, round(quantile_cont(lev, 0.95), 6) AS p95, arg_min(d, (-lev, d)) AS top_day FROM v WHERE lev IS NOT NULL GROUP BY 1", DAILY_SQL)
def leverage_diagnostics(spark, sf):
    v = returns(spark, sf).select("d", F.least(F.try_divide(F.lit(0.2), rolling(F.stddev_samp, F.col("r"), day(), 5)), F.lit(4.0)).alias("lev"), rolling(F.stddev_samp, F.col("r"), day(), 5).alias("v")).where("v is not null")
    band = F.when(F.col("lev") < 1, "low").when(F.col("lev") < 2, "mid").otherwise("high")
    return v.groupBy(band.alias("band")).agg(F.count("*").alias("n"), r8(F.avg("lev"), 6).alias("mean"), r8(F.percentile("lev", 0.95), 6).alias("p95"), F.min_by("d", F.struct(-F.col("lev"), F.col("d"))).alias("top_day"))


@query(", x AS (SELECT d, ln(1 + r) - ln(1 + b) AS g FROM pair) SELECT count(*) AS n, round(sum(g), 6) AS log_relative, (SELECT d FROM x ORDER BY abs(g) DESC, d LIMIT 1) AS top_day FROM x", DAILY_SQL)
def relative_wealth_top_day(spark, sf):
    x = pair(spark, sf).select("d", (F.log1p("r") - F.log1p("b")).alias("g"))
    return x.agg(F.count("*").alias("n"), r8(F.sum("g"), 6).alias("log_relative"), F.min_by("d", F.struct(-F.abs("g"), F.col("d"))).alias("top_day"))


@query("WITH t(y, jan, feb, mar) AS (VALUES (2001, 1.5, NULL, 2.5), (2002, NULL, 3.5, -1.0)) SELECT y::INT AS y, m, v::DOUBLE AS v FROM (UNPIVOT t ON jan, feb, mar INTO NAME m VALUE v)")
def unpivot_reference(spark, sf):
    t = spark.sql("SELECT * FROM VALUES (2001, 1.5d, NULL, 2.5d), (2002, NULL, 3.5d, -1d) AS t(y, jan, feb, mar)")
    return t.unpivot("y", ["jan", "feb", "mar"], "m", "v").where("v is not null")


@query(", x AS (SELECT d, r - avg(r) OVER () AS x FROM ret WHERE r IS NOT NULL), l AS (SELECT x, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(x, 3) OVER w AS x3 FROM x WINDOW w AS (ORDER BY d)) SELECT count(*) AS n, round((sum(x * x) + 2 * (0.75 * sum(x * x1) + 0.5 * sum(x * x2) + 0.25 * sum(x * x3))) / count(*), 10) AS variance FROM l", DAILY_SQL)
def long_run_covariance(spark, sf):
    return inference.long_run_variance(returns(spark, sf).where("r is not null").select("d", "r"), 3).select("n", r8("variance", 10).alias("variance"))


@query(", x AS (SELECT r - avg(r) OVER () AS x FROM ret WHERE r IS NOT NULL) SELECT round(pow(sum(x * x), 2) / sum(x * x * x * x), 6) AS neff FROM x", DAILY_SQL)
def concentration_neff(spark, sf):
    return inference.concentration(returns(spark, sf).where("r is not null").select("d", "r")).select(r8("neff", 6).alias("neff"))


@query(", x AS (SELECT r, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM ret WHERE r IS NOT NULL), s AS (SELECT rep, b, o, n FROM range(50) t(rep), (SELECT DISTINCT n FROM x), range(2000) u(b), range(20) v(o) WHERE b < ceil(n / 20.0) AND b * 20 + o < n) SELECT rep, round(avg(r), 8) AS mean, round(stddev_samp(r), 8) AS sd FROM s JOIN x ON x.i = ((rep * 7919 + b * 104729 + 12345) % s.n + o) % s.n GROUP BY 1", DAILY_SQL)
def bootstrap_moments(spark, sf):
    return inference.block_bootstrap(returns(spark, sf).where("r is not null").select("d", "r"), 50, 20).select("rep", r8("mean").alias("mean"), r8("sd").alias("sd"))


@query(""", t AS (SELECT d, CASE WHEN abs(r) < 0.1 THEN 'quiet' WHEN abs(r) < 0.25 THEN 'mid' ELSE 'wild' END AS bucket, CASE WHEN d < DATE '1998-01-01' THEN 'pre' ELSE 'post' END AS period, r FROM ret WHERE r IS NOT NULL),
 g AS (SELECT bucket, period, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY period) AS f, avg(r) AS p FROM t GROUP BY 1, 2)
 SELECT a.bucket, round((z.f - a.f) * (z.p + a.p) / 2, 8) AS frequency, round((z.p - a.p) * (z.f + a.f) / 2, 8) AS payoff FROM g a JOIN g z ON a.bucket = z.bucket WHERE a.period = 'pre' AND z.period = 'post'""", DAILY_SQL)
def shapley_frequency_payoff(spark, sf):
    r = F.abs("r")
    t = returns(spark, sf).where("r is not null").groupBy(F.when(r < 0.1, "quiet").when(r < 0.25, "mid").otherwise("wild").alias("bucket"), F.when(F.col("d") < "1998-01-01", "pre").otherwise("post").alias("period")).agg(F.count("*").alias("n"), F.avg("r").alias("p"))
    t = t.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("period")))
    a, z = (t.where(F.col("period") == x).select("bucket", F.col("f").alias(f"f{k}"), F.col("p").alias(f"p{k}")) for k, x in enumerate(("pre", "post")))
    return a.join(z, "bucket").select("bucket", r8((F.col("f1") - F.col("f0")) * (F.col("p1") + F.col("p0")) / 2).alias("frequency"), r8((F.col("p1") - F.col("p0")) * (F.col("f1") + F.col("f0")) / 2).alias("payoff"))


@query("SELECT 'lev' || l::INT || '_' || replace(printf('%.4f', s), '.', 'p') AS cell_id, l::DOUBLE AS leverage, s::DOUBLE AS slippage FROM (VALUES (1), (2), (4)) a(l), (VALUES (0.001), (0.0025), (0.005), (0.01)) b(s)")
def matrix_cells(spark, sf):
    a, b = (spark.sql(f"SELECT explode(array({x})) AS {c}") for x, c in (("1d, 2d, 4d", "leverage"), ("0.001d, 0.0025d, 0.005d, 0.01d", "slippage")))
    return a.crossJoin(b).select(F.concat(F.format_string("lev%.0f_", "leverage"), F.replace(F.format_string("%.4f", "slippage"), F.lit("."), F.lit("p"))).alias("cell_id"), "leverage", "slippage")


def queries() -> dict:
    from tickloom.plans import audits, comparisons, daily, ingestion, rates, reports, statistics, summaries  # noqa: F401  (they register theirs)

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_band_vwap(spark, sf_dir)
