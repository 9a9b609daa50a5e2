"""Price-bar views: minute bars from ticks, daily closes, the dense session grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTES = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, m, open, high, low, close, volume): ticks rolled up by session date and minute of session."""
    e = table(spark, sf_dir, "events").select("ts", "event_id", "value")
    at = F.struct("ts", "event_id")
    return e.groupBy(F.to_date("ts").alias("d"), (F.hour("ts") + 1).alias("m")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume")
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d): the sessions, one a day from the first tick to the last, days without any tick too."""
    ends = table(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("z")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "z")).alias("d"))


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars as a poor tape has them, by digits of hashes of day and minute: absent, cut off and sparse sessions, minutes without a bar, bars of one price and bars without volume."""
    digit = lambda c: F.substring(F.md5(c), 1, 1)
    b = bars(spark, sf_dir).withColumn("_d", digit(F.col("d").cast("string"))).withColumn("_m", digit(F.concat(F.col("d").cast("string"), F.lit(":"), F.col("m").cast("string"))))
    gone = F.col("_m").isin("0", "1") | (F.col("_d") == "0") | (F.col("_d").isin("2", "3") & (F.col("m") > 16)) | ((F.col("_d") == "4") & (F.col("m") > 8))
    whole = F.col("_d").isin("8", "9")
    b = b.where(~gone | whole)
    one = F.col("_m").isin("4", "5", "6", "7")
    prices = [F.when(one, 100.0).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close")]
    return b.select("d", "m", *prices, F.when(F.col("_m").isin("8", "9"), F.lit(0)).otherwise(F.col("volume")).alias("volume"))


def grid(spark: SparkSession, sf_dir: str, of=bars) -> DataFrame:
    """Bars on the dense grid: a row for each session of the calendar and scheduled minute, null where nothing was observed."""
    b = of(spark, sf_dir)
    slots = calendar(spark, sf_dir).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(MINUTES))))
    return slots.join(b, ["d", "m"], "left")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, close): a daily series, the mean order value rounded to cents."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.round(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("close"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, close): a second daily series."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.round(F.avg(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).alias("close"))


BARS_SQL = """
bars AS (
  SELECT ts::DATE AS d, (hour(ts) + 1)::INT AS m, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2
), grid AS (
  SELECT s.d, t.m::INT AS m, open, high, low, close, volume FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM bars) s CROSS JOIN range(1, 25) t(m) LEFT JOIN bars b ON b.d = s.d AND b.m = t.m
)"""
HOLED_SQL = """
bars0 AS (
  SELECT ts::DATE AS d, (hour(ts) + 1)::INT AS m, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2
), marks AS (SELECT *, md5(d::VARCHAR)[1] AS kd, md5(d::VARCHAR || ':' || m)[1] AS km FROM bars0
), bars AS (
  SELECT d, m, CASE WHEN km IN ('4', '5', '6', '7') THEN 100 ELSE open END AS open, CASE WHEN km IN ('4', '5', '6', '7') THEN 100 ELSE high END AS high, CASE WHEN km IN ('4', '5', '6', '7') THEN 100 ELSE low END AS low,
    CASE WHEN km IN ('4', '5', '6', '7') THEN 100 ELSE close END AS close, CASE WHEN km IN ('8', '9') THEN 0 ELSE volume END AS volume FROM marks
  WHERE NOT (km IN ('0', '1') OR kd = '0' OR (kd IN ('2', '3') AND m > 16) OR (kd = '4' AND m > 8)) OR kd IN ('8', '9')
), grid AS (
  SELECT s.d, t.m::INT AS m, open, high, low, close, volume FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM bars0) s CROSS JOIN range(1, 25) t(m) LEFT JOIN bars b ON b.d = s.d AND b.m = t.m
)"""
DAILY_SQL = """
daily AS (SELECT o_orderdate::DATE AS d, round(avg(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS close FROM orders GROUP BY 1),
daily2 AS (SELECT l_shipdate::DATE AS d, round(avg(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS close FROM lineitem GROUP BY 1),
ret AS (SELECT d, close, close / lag(close) OVER (ORDER BY d) - 1 AS r FROM daily),
pair AS (SELECT a.d, a.r, b.r AS b FROM ret a JOIN (SELECT d, close / lag(close) OVER (ORDER BY d) - 1 AS r FROM daily2) b ON a.d = b.d WHERE a.r IS NOT NULL AND b.r IS NOT NULL)"""
