"""Queries of raw bars: names, times, duplicates, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import times
from tickloom.operators import cleaning, sessions
from tickloom.plans.catalogue import _repeated, query, r8
from tickloom.sources import tables
from tickloom.sources.bars import BARS_SQL, bars, calendar, table

ALIASES = {"ts": ["timestamp", "event_time"], "symbol": ["ticker"], "close": ["last", "price"]}


@query("SELECT ts, user_id::VARCHAR AS symbol, value AS close FROM events")
def resolved_columns(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").alias("Event Time"), F.col("user_id").cast("string").alias(" Ticker"), F.col("value").alias("PRICE"), F.lit(1).alias("other"))
    return tables.resolved(e, ALIASES, ["ts", "close"])


@query("SELECT CASE WHEN avg((event_id % 3 <> 0)::INT) >= avg((event_id % 7 <> 0)::INT) THEN 'a' ELSE 'b' END AS chosen, count(*) AS n FROM events")
def fullest_timestamp(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("a"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("b"))
    return e.agg(F.lit(tables.fullest(e, ["a", "b", "c"])).alias("chosen"), F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, count(value) FILTER (event_id % 10 <> 0) AS numeric FROM events GROUP BY 1")
def numeric_cast_nulls(spark, sf):
    e = table(spark, sf, "events").withColumn("text", F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("value").cast("string")))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count(tables.numeric("text")).alias("numeric"))


@query("SELECT event_id, value FROM events WHERE upper(event_type) = upper((SELECT min(event_type) FROM events))")
def symbol_rows(spark, sf):
    e = table(spark, sf, "events")
    return tables.of_symbol(e, e.agg(F.min("event_type")).first()[0].lower(), "event_type").select("event_id", "value")


@query("SELECT event_id, date_trunc('millisecond', ts) AS t FROM events")
def parsed_epoch(spark, sf):
    """Numbers of an unknown unit, as text."""
    e = table(spark, sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("t"))
    return times.parsed(e, "t")


_LOCAL = "SELECT event_id, CASE WHEN u AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' = n AND (u + INTERVAL 1 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' <> n AND (u - INTERVAL 1 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' <> n THEN u END AS t FROM (SELECT event_id, n, n AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS u FROM (SELECT event_id, date_trunc('second', ts) AS n FROM events))"


@query(_LOCAL)
def parsed_local(spark, sf):
    """Local times of New York as text: those that the clock skips or shows twice are null."""
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"))
    return times.parsed(e, "t", "America/New_York")


@query(_LOCAL)
def parsed_pattern(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy HH.mm.ss").alias("t"))
    return times.parsed(e, "t", "America/New_York", "dd/MM/yyyy HH.mm.ss")


@query("SELECT event_id, date_trunc('second', ts) - INTERVAL 3 HOUR AS t FROM events")
def parsed_offset(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00")).alias("t"))
    return times.parsed(e, "t")


@query("SELECT event_id, length(rtrim(split_part(printf('%.8f', value), '.', 2), '0')) AS places, second(t) = 0 AND microsecond(t) % 1000000 = 0 AS on_grid FROM (SELECT *, CASE WHEN event_type = 'view' THEN date_trunc('minute', ts) ELSE ts END AS t FROM events)")
def decimals_and_grid(spark, sf):
    t = F.when(F.col("event_type") == "view", F.date_trunc("minute", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    return table(spark, sf, "events").select("event_id", times.decimals(F.col("value")).cast("long").alias("places"), times.on_grid(t).alias("on_grid"))


_SESSIONS = ", cal AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM bars), sch AS (SELECT d, d + INTERVAL 570 MINUTE AS opens, d + INTERVAL 960 MINUTE AS closes FROM cal WHERE day(d) % 5 <> 0)"


def _schedule(spark, sf):
    opens = F.col("d").cast("timestamp")
    return calendar(spark, sf).where(F.dayofmonth("d") % 5 != 0).select("d", (opens + F.expr("interval 570 minutes")).alias("opens"), (opens + F.expr("interval 960 minutes")).alias("closes"))


@query(_SESSIONS + ", a AS (SELECT event_id, ts, d, opens, closes FROM events ASOF LEFT JOIN sch ON events.ts >= sch.opens) SELECT event_id, d, coalesce(ts < closes, false) AS inside, round_even(date_diff('microsecond', opens, ts) / 60000000.0, 0)::INT + 1 AS m FROM a", BARS_SQL)
def attached_ticks(spark, sf):
    """The latest session that opened: some days have none, some ticks come before the first."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions.attached(e, _schedule(spark, sf)).select("event_id", "d", "inside", "m")


@query(_SESSIONS + ", a AS (SELECT ts, d, opens, closes FROM events ASOF LEFT JOIN sch ON events.ts >= sch.opens) SELECT count(*) FILTER (ts > opens AND ts <= closes) AS inside, count(*) FILTER (NOT coalesce(ts > opens AND ts <= closes, false)) AS outside, count(*) AS n FROM a", BARS_SQL)
def rows_conserved(spark, sf):
    """Rows inside and outside of sessions, by end labels, add up to all."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return sessions.attached(e, _schedule(spark, sf), "end").agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"), F.count("*").alias("n"))


@query(", cal AS (SELECT d, NOT (day(d) % 5 <> 0 AND day(d) % 6 <> 0) AS gone FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM bars)), k AS (SELECT gone, row_number() OVER (ORDER BY d) - sum(gone::INT) OVER (ORDER BY d) AS run FROM cal) SELECT coalesce(max(n), 0) AS longest FROM (SELECT count(*) AS n FROM k WHERE gone GROUP BY run)", BARS_SQL)
def longest_absence(spark, sf):
    day = F.dayofmonth("d")
    return sessions.longest_run(calendar(spark, sf).withColumn("gone", ~((day % 5 != 0) & (day % 6 != 0))), "gone", "d")


_REP = "e AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value END AS value, 1 AS pos, 'tape' AS src FROM events UNION ALL SELECT event_id, value + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, 2, 'vendor' FROM events WHERE event_id % 5 = 0)"


def _sourced(spark, sf):
    e = _repeated(spark, sf)
    return e.select("event_id", F.when((F.col("pos") == 2) | (F.col("event_id") % 11 != 0), F.col("value")).alias("value"), "pos", F.when(F.col("pos") == 1, "tape").otherwise("vendor").alias("src"))


@query(f"WITH {_REP} SELECT event_id, count(*) AS n, count(DISTINCT coalesce(value::VARCHAR, 'null')) AS variants FROM e GROUP BY 1 HAVING variants > 1")
def conflicting_keys(spark, sf):
    """Null is a value: a key with a null and a number conflicts."""
    return cleaning.conflicts(_sourced(spark, sf), "event_id", ["value"])


@query(f"WITH {_REP} SELECT event_id, value, pos, src FROM e QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY src = 'vendor' DESC, pos DESC) = 1")
def dedupe_source(spark, sf):
    return cleaning.resolved(_sourced(spark, sf), "event_id", ["value"], "source", "pos", "src", ["vendor", "tape"])


@query(f"WITH {_REP} SELECT event_id, value, pos, src FROM e QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY pos DESC) = 1")
def dedupe_last(spark, sf):
    return cleaning.resolved(_sourced(spark, sf), "event_id", ["value"], "last", "pos")


@query("SELECT event_id, value FROM events")
def dedupe_identical(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return cleaning.resolved(e.withColumn("pos", F.lit(1)).unionByName(e.where("event_id % 5 = 0").withColumn("pos", F.lit(2))), "event_id", ["value"], "identical", "pos").drop("pos")


def _amounts(spark, sf):
    return table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"), F.col("l_quantity").cast("decimal(18,2)").alias("amount"))


@query("SELECT d, sum(amount)::DOUBLE AS amount, count(*) AS n FROM (SELECT DISTINCT l_shipdate::DATE AS d, l_quantity::DECIMAL(18,2) AS amount FROM lineitem) GROUP BY 1")
def dividends_sum(spark, sf):
    return cleaning.dividends(_amounts(spark, sf), "sum").withColumn("amount", F.col("amount").cast("double"))


@query("SELECT d, min(amount)::DOUBLE AS amount, count(*) AS n FROM (SELECT DISTINCT l_shipdate::DATE AS d, l_quantity::DECIMAL(18,2) AS amount FROM lineitem) GROUP BY 1")
def dividends_first(spark, sf):
    return cleaning.dividends(_amounts(spark, sf), "first").withColumn("amount", F.col("amount").cast("double"))


@query(", t AS (SELECT d, count(*) AS n, sum(volume)::BIGINT AS volume, count(*) FILTER (high >= close * 1.5) AS extreme FROM bars GROUP BY 1) SELECT CASE WHEN month(d) <= 6 THEN 'h1' ELSE 'h2' END AS regime, count(*) AS sessions, sum(n)::BIGINT AS bars, round(sum(n) / sum(sum(n)) OVER (), 8) AS share, sum(extreme)::BIGINT AS extreme, max(volume) AS most, round(quantile_cont(volume, 0.5), 6) AS median_volume FROM t GROUP BY 1", BARS_SQL)
def regime_profile(spark, sf):
    from pyspark.sql.window import Window

    t = bars(spark, sf).groupBy("d").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.count_if(F.col("high") >= F.col("close") * 1.5).alias("extreme"))
    p = t.groupBy(F.when(F.month("d") <= 6, "h1").otherwise("h2").alias("regime")).agg(F.count("*").alias("sessions"), F.sum("n").alias("bars"), F.sum("extreme").alias("extreme"), F.max("volume").alias("most"), r8(F.percentile("volume", 0.5), 6).alias("median_volume"))
    return p.withColumn("share", r8(F.col("bars") / F.sum("bars").over(Window.partitionBy())))
