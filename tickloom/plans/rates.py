"""Queries of fee schedules, financing curves and nested payloads, over rates derived from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators import curves, schedules
from tickloom.plans.catalogue import query, r8
from tickloom.sources import payloads
from tickloom.sources.bars import DAILY_SQL, daily, table

SITE = "https://rates.example/"
_MONTHS = "SELECT date_trunc('month', o_orderdate)::DATE AS f, (floor(avg(o_totalprice::DECIMAL(18,2))::DOUBLE / 10000 * 1e2 + 0.5) / 1e2) AS p FROM orders GROUP BY 1"
_SCHEDULE = f"WITH m AS ({_MONTHS}), sch AS (SELECT f, lead(f) OVER (ORDER BY f) - 1 AS t, p FROM m)"


def mean(c: str, places: int):
    """A rounded mean; halves go up by arithmetic, which engines do alike."""
    return F.floor(F.avg(F.col(c).cast("decimal(18,2)")).cast("double") / 10_000 * float(10**places) + 0.5) / float(10**places)


def schedule(spark, sf, period: str = "month", keys: tuple[str, ...] = ()) -> DataFrame:
    """A fee schedule: an interval for each month or quarter of orders, the last one open, with a rate by their prices."""
    m = table(spark, sf, "orders").groupBy(*keys, F.date_trunc(period, "o_orderdate").cast("date").alias("effective_from")).agg(mean("o_totalprice", 2).alias("rate_per_million"))
    after = F.lead("effective_from").over(Window.partitionBy(*keys).orderBy("effective_from"))
    return m.select(*keys, "effective_from", F.date_sub(after, 1).alias("effective_to"), "rate_per_million", (F.col("rate_per_million") / 1e6).alias("rate_decimal"), F.lit(SITE).alias("source_url"), F.lit("").alias("notes"))


_BROKEN = (
    _SCHEDULE
    + """, k AS (SELECT *, (year(f) - 1995) * 12 + month(f) - 1 AS i FROM sch), two AS (SELECT * FROM k UNION ALL SELECT * FROM k WHERE i % 13 = 5),
 b AS (SELECT CASE WHEN i % 17 <> 3 THEN f END AS f, CASE WHEN i % 19 = 7 THEN NULL WHEN i % 31 = 8 THEN f - 5 WHEN i % 37 = 6 THEN t - 3 ELSE t END AS t,
  CASE WHEN i % 11 = 4 THEN -1 WHEN i % 23 = 9 THEN 'NaN'::DOUBLE ELSE p END AS p, i % 29 = 2 AS off, CASE WHEN i % 7 = 1 THEN 'http://elsewhere/' WHEN i % 41 <> 10 THEN 'https://rates.example/' END AS url FROM two),
 n AS (SELECT *, p / 1e6 + CASE WHEN off THEN 1 ELSE 0 END AS dec, CASE WHEN f IS NOT NULL THEN lead(f) OVER (PARTITION BY f IS NULL ORDER BY f, t) END AS nx FROM b)"""
)


@query(_BROKEN + """ SELECT rule, count(*) AS n, min(f) AS first FROM (SELECT 'start' AS rule, f FROM n WHERE f IS NULL UNION ALL SELECT 'repeated_start', f FROM n WHERE f = nx UNION ALL SELECT 'open_end', f FROM n WHERE t IS NULL AND nx IS NOT NULL
 UNION ALL SELECT 'rate', f FROM n WHERE p < 0 OR isnan(p) OR dec < 0 OR isnan(dec) UNION ALL SELECT 'decimal', f FROM n WHERE abs(dec - p / 1e6) > 1e-15 UNION ALL SELECT 'reversed', f FROM n WHERE t < f
 UNION ALL SELECT 'contiguous', f FROM n WHERE nx <> t + 1 UNION ALL SELECT 'source', f FROM n WHERE url IS NULL OR NOT starts_with(url, 'https://rates.example/')) GROUP BY 1""")
def schedule_faults(spark, sf):
    """A schedule that is broken in every way, as text; what is wrong is counted, nothing stops."""
    k = schedule(spark, sf).withColumn("i", (F.year("effective_from") - 1995) * 12 + F.month("effective_from") - 1)
    k = k.unionByName(k.where("i % 13 = 5"))
    to = F.expr("case when i % 19 = 7 then null when i % 31 = 8 then date_sub(effective_from, 5) when i % 37 = 6 then date_sub(effective_to, 3) else effective_to end")
    per = F.expr("case when i % 11 = 4 then -1 when i % 23 = 9 then double('NaN') else rate_per_million end")
    raw = k.select(
        F.expr("if(i % 17 <> 3, string(effective_from), 'unknown')").alias("effective_from"), to.cast("string").alias("effective_to"), per.cast("string").alias("rate_per_million"),
        (per / 1e6 + F.expr("if(i % 29 = 2, 1, 0)")).cast("string").alias("rate_decimal"), F.expr(f"case when i % 7 = 1 then 'http://elsewhere/' when i % 41 <> 10 then '{SITE}' end").alias("source_url"), "notes",
    )
    return schedules.faults(schedules.typed(raw), SITE)


@query(_SCHEDULE + " SELECT f AS effective_from, count(*) AS n, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE * any_value(p / 1e6), 4) AS fee FROM lineitem JOIN sch ON l_shipdate::DATE >= f AND (t IS NULL OR l_shipdate::DATE <= t) GROUP BY 1")
def effective_rates(spark, sf):
    """Every line at the rate of its day, by a schedule that was checked; a day without a rate would stop the job."""
    s = schedules.checked(schedule(spark, sf), SITE).withColumn("of", F.struct("effective_from", "rate_decimal"))
    facts = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    by = schedules.effective(facts, s, "day", "of").groupBy("of").agg(F.count("*").alias("n"), F.sum("price").alias("price"))
    return by.select("of.effective_from", "n", F.round(F.col("price").cast("double") * F.col("of.rate_decimal"), 4).alias("fee"))


@query("WITH q AS (SELECT o_orderpriority AS k, date_trunc('quarter', o_orderdate)::DATE AS f, (floor(avg(o_totalprice::DECIMAL(18,2))::DOUBLE / 10000 * 1e2 + 0.5) / 1e2) / 1e6 AS r FROM orders GROUP BY 1, 2), o AS (SELECT o_orderpriority, date_trunc('quarter', o_orderdate)::DATE AS f, o_totalprice::DECIMAL(18,2) AS p FROM orders) SELECT o_orderpriority, count(*) AS n, round(sum(p * r::DECIMAL(18,10))::DOUBLE, 4) AS fee FROM o JOIN q ON o_orderpriority = k AND o.f = q.f GROUP BY 1")
def keyed_rates(spark, sf):
    """A schedule for each priority, in quarters."""
    s = schedules.checked(schedule(spark, sf, "quarter", ("o_orderpriority",)), SITE, ("o_orderpriority",))
    facts = table(spark, sf, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    out = schedules.covered(facts, s, "day", "rate_decimal", ("o_orderpriority",))
    return out.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("price") * F.col("rate_decimal").cast("decimal(18,10)")).cast("double"), 4).alias("fee"))


@query(_SCHEDULE + ", s AS (SELECT * FROM sch WHERE month(f) <> 8) SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM s WHERE l_shipdate::DATE >= f AND (t IS NULL OR l_shipdate::DATE <= t)) GROUP BY 1")
def uncovered_days(spark, sf):
    """Days of lines that a schedule without its Augusts misses."""
    facts = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return schedules.uncovered(facts, schedule(spark, sf).where(F.month("effective_from") != 8), "day")


_CURVE = (
    DAILY_SQL
    + """, mon AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, (floor(avg(l_extendedprice::DECIMAL(18,2))::DOUBLE / 10000 * 1e4 + 0.5) / 1e4) AS rate FROM lineitem GROUP BY 1),
 obs AS (SELECT l_shipdate::DATE AS d, (floor(avg(l_extendedprice::DECIMAL(18,2))::DOUBLE / 10000 * 1e4 + 0.5) / 1e4) AS rate FROM lineitem WHERE isodow(l_shipdate) IN (1, 3, 5) GROUP BY 1),
 one AS (SELECT d, 'monthly' AS benchmark, strftime(month, '%Y-%m') AS observation, 'previous_completed_month' AS policy, rate, date_diff('day', last_day(date_trunc('month', d)::DATE - 1), d)::INT AS age FROM daily LEFT JOIN mon ON month = date_trunc('month', d) - INTERVAL 1 MONTH WHERE d <= DATE '1998-06-30'),
 two AS (SELECT s.d, 'daily' AS benchmark, obs.d::VARCHAR AS observation, 'latest_strictly_before' AS policy, CASE WHEN s.d - obs.d <= 2 THEN rate END AS rate, (s.d - obs.d)::INT AS age FROM (SELECT d FROM daily WHERE d >= DATE '1998-07-06') s ASOF LEFT JOIN obs ON s.d > obs.d),
 curve AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT d, NULL, NULL, NULL, NULL, NULL FROM daily WHERE d > DATE '1998-06-30' AND d < DATE '1998-07-06')"""
)


def financing(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"), "l_extendedprice")
    monthly = lines.groupBy(F.trunc("d", "MM").alias("month")).agg(mean("l_extendedprice", 4).alias("rate"))
    published = lines.where(F.dayofweek("d").isin(2, 4, 6)).groupBy("d").agg(mean("l_extendedprice", 4).alias("rate"))
    return curves.point_in_time(daily(spark, sf), monthly, published, "1998-06-30", "1998-07-06", -25, 75, 25, stale_days=2)


@query(_CURVE + " SELECT d, benchmark, observation, policy, round(rate, 8) AS percent, round(rate / 100 - 0.0025, 8) AS cash, round(rate / 100 + 0.0075, 8) AS funding, CASE WHEN rate IS NOT NULL THEN 0.0025::DOUBLE END AS borrow, age FROM curve", " ")
def financing_curve(spark, sf):
    """What was known each day: the month before up to a cut-over, then the latest published day unless it is stale; five days between are bare."""
    return financing(spark, sf).select("d", "benchmark", "observation", "policy", *[r8(c).alias(n) for c, n in zip(curves.RATES, ("percent", "cash", "funding", "borrow"), strict=True)], "age")


@query(_CURVE + """, c AS (SELECT d, rate FROM curve WHERE day(d) <> 9 UNION ALL SELECT d, rate FROM curve WHERE day(d) = 20 UNION ALL SELECT d + 20000, rate FROM curve WHERE day(d) = 28), g AS (SELECT d, count(*) AS n, count(*) - count(rate) AS bad FROM c GROUP BY 1)
 SELECT * FROM (SELECT 'repeated_session' AS rule, count(*) AS n FROM g WHERE n > 1 UNION ALL SELECT 'missing_session', count(*) FROM daily WHERE d NOT IN (SELECT d FROM g) UNION ALL SELECT 'unknown_session', count(*) FROM g WHERE d NOT IN (SELECT d FROM daily) UNION ALL SELECT 'rate', count(*) FROM g WHERE bad > 0) WHERE n > 0""", " ")
def curve_faults(spark, sf):
    """A curve that lacks, repeats and invents sessions, and has bare rates."""
    c = financing(spark, sf)
    day = F.dayofmonth("d")
    broken = c.where(day != 9).unionByName(c.where(day == 20)).unionByName(c.where(day == 28).withColumn("d", F.date_add("d", 20_000)))
    return curves.curve_faults(broken, daily(spark, sf))


@query("WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, p.ts AS observed, p.value FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts")
def asof_by_user(spark, sf):
    """The user's latest purchase strictly before each event: two inputs by key and time."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return curves.asof_before(e.select("event_id", "user_id", "ts"), bought, "ts", ("value",), ("user_id",), "day").select("event_id", "observed", "value")


def _charts(spark, sf) -> DataFrame:
    """Orders by day as chart payloads, one a year, in the nesting that quotes are served in."""
    at = F.struct("o_orderdate", "o_orderkey")
    bars = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.min_by("o_totalprice", at).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", at).alias("close"), F.count("*").cast("double").alias("volume"))
    bars = bars.withColumn("timestamp", F.unix_timestamp(F.col("d").cast("timestamp")) + 16 * 3600)
    years = bars.groupBy(F.year("d").alias("y")).agg(F.array_sort(F.collect_list(F.struct("timestamp", *payloads.OHLC, "volume"))).alias("rows"))
    quote = F.struct(*[F.col(f"rows.{c}").alias(c) for c in (*payloads.OHLC, "volume")])
    result = F.struct(F.col("rows.timestamp").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    return years.select(F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("payload"))


_OHLC = "SELECT o_orderdate::DATE AS d, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1"


@query(_OHLC)
def chart_payload(spark, sf):
    return payloads.chart_bars(_charts(spark, sf))


@query(f"WITH b AS ({_OHLC}), x AS (SELECT d, open, CASE WHEN day(d) = 5 THEN low - 1 ELSE high END AS high, CASE WHEN day(d) = 4 THEN -1 ELSE low END AS low, CASE WHEN day(d) <> 3 THEN close END AS close FROM b), t AS (SELECT * FROM x UNION ALL SELECT * FROM x WHERE day(d) = 6), r AS (SELECT d, CASE WHEN close IS NULL THEN 'missing' WHEN least(open, high, low, close) <= 0 THEN 'nonpositive' WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 'bounds' END AS rule FROM t) SELECT rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY 1 UNION ALL SELECT 'repeated', count(*) FROM (SELECT d FROM t GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0")
def chart_faults(spark, sf):
    """Days without a close, below 0, with high under low, and twice."""
    day = F.dayofmonth("d")
    b = payloads.chart_bars(_charts(spark, sf)).withColumn("high", F.when(day == 5, F.col("low") - 1).otherwise(F.col("high"))).withColumn("low", F.when(day == 4, -1.0).otherwise(F.col("low"))).withColumn("close", F.when(day != 3, F.col("close")))
    return payloads.chart_faults(b.unionByName(b.where(day == 6)))


_LINES = "SELECT l_shipdate::DATE AS d, (floor(avg(l_extendedprice::DECIMAL(18,2))::DOUBLE / 10000 * 1e4 + 0.5) / 1e4) AS rate FROM lineitem GROUP BY 1"


def _rates(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(mean("l_extendedprice", 4).alias("rate"))


@query(_LINES)
def pair_payload(spark, sf):
    """Rates by day as pair lists, one payload a year."""
    pair = F.array(F.col("d").cast("string"), F.col("rate").cast("string"))
    meta = F.struct(F.lit("RATE").alias("mnemonic"), F.struct(F.lit("Percent").alias("name")).alias("unit")).alias("metadata")
    years = _rates(spark, sf).groupBy(F.year("d")).agg(F.collect_list(pair).alias("aggregation"))
    texts = years.select(F.to_json(F.struct(F.struct(meta, F.struct("aggregation").alias("timeseries")).alias("RATE"))).alias("payload"))
    return payloads.pair_rates(texts, "RATE")


@query("SELECT date_trunc('month', l_shipdate)::DATE AS month, (floor(avg(l_extendedprice::DECIMAL(18,2))::DOUBLE / 10000 * 1e4 + 0.5) / 1e4) AS rate FROM lineitem GROUP BY 1")
def monthly_series(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("TIME_PERIOD")).agg(mean("l_extendedprice", 4).cast("string").alias("OBS_VALUE"))
    return payloads.monthly_rates(m.select("*", F.lit("SERIES").alias("KEY"), F.lit("PCPA").alias("UNIT"), F.lit("A").alias("COLLECTION")), "SERIES")


@query(f"WITH l AS ({_LINES}), t AS (SELECT d, rate AS close FROM l WHERE day(d) <> 11 UNION ALL SELECT d, rate + 1 FROM l WHERE isodow(d) = 1 AND day(d) <> 11) SELECT d, max(close) AS close FROM t GROUP BY 1 HAVING count(*) = 1")
def benchmark_closes(spark, sf):
    """Mondays come twice, so neither row of them is used; the eleventh of a month has no number."""
    l_ = _rates(spark, sf)
    text = lambda df, x: df.select(F.col("d").cast("string").alias(" Session Date"), F.when(F.dayofmonth("d") == 11, "n/a").otherwise(x.cast("string")).alias("CLOSE"))
    return payloads.benchmark_closes(text(l_, F.col("rate")).unionByName(text(l_.where(F.dayofweek("d") == 2), F.col("rate") + 1)))


@query("SELECT o_orderdate::DATE AS d, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS numeric, round(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus <> 'P')::DOUBLE, 2) AS total FROM orders GROUP BY 1")
def csv_coerced(spark, sf):
    """Text columns: days by a pattern, prices of which some are no numbers."""
    raw = table(spark, sf, "orders").select(F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    rows = payloads.csv_dates(raw, "day", ["price"], "dd.MM.yyyy")
    return rows.groupBy(F.col("day").alias("d")).agg(F.count("*").alias("n"), F.count("price").alias("numeric"), F.round(F.sum(F.col("price").cast("decimal(18,2)")).cast("double"), 2).alias("total"))
