"""Daily tables out of nested JSON and loose CSV: charts of parallel arrays, pair lists, monthly series, closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.sources.tables import plain_names

OHLC = ("open", "high", "low", "close")
CHART = "chart struct<error:string, result:array<struct<timestamp:array<bigint>, indicators:struct<quote:array<struct<open:array<double>, high:array<double>, low:array<double>, close:array<double>, volume:array<double>>>>>>>"
PAIRS = "map<string, struct<metadata:struct<mnemonic:string, unit:struct<name:string>>, timeseries:struct<aggregation:array<array<string>>>>>"


def _stops(column: str, kind: str, bad: Column, message: str) -> Column:
    """`column`, or where `bad` holds an error that ends the job."""
    return F.when(bad, F.raise_error(message).cast(kind)).otherwise(F.col(column))


def chart_bars(payloads: DataFrame, column: str = "payload", zone: str = "America/New_York") -> DataFrame:
    """(d, open, high, low, close, volume) of charts: arrays of epoch seconds and of each price, in parallel. d is the day in `zone`. One payload is one row; rows come from inline(), nothing is collected.

    What can't be read as JSON, an error in the payload and arrays of unequal length end the job. Prices and days aren't judged here: see chart_faults().
    """
    read = payloads.select(F.from_json(column, CHART).alias("_p"), F.col(column).alias("_raw"))
    error = read.withColumn("_p", _stops("_p", read.schema["_p"].dataType.simpleString(), F.col("_p.chart").isNull() | F.col("_p.chart.error").isNotNull() | F.col("_p.chart.result").isNull(), "chart: an error, or no chart"))
    one = error.select(F.col("_p.chart.result")[0].alias("_r")).select(F.col("_r.timestamp").alias("timestamp"), F.col("_r.indicators.quote")[0].alias("_q")).select("timestamp", "_q.*")
    fields = ("timestamp", *OHLC, "volume")
    unequal = F.lit(False)
    for c in fields[1:]:
        unequal |= ~F.size(c).eqNullSafe(F.size("timestamp"))
    one = one.withColumn("timestamp", _stops("timestamp", "array<bigint>", unequal, "chart: arrays of unequal length"))
    rows = one.select(F.inline(F.arrays_zip(*fields)))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds("timestamp").cast("timestamp_ntz")))
    return rows.select(local.cast("date").alias("d"), *OHLC, "volume")


def ohlc_ok() -> Column:
    """Prices are there, above 0, and neither high nor low is inside of the others."""
    there = F.lit(True)
    for c in OHLC:
        there &= F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0)
    return there & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))


def chart_faults(bars: DataFrame) -> DataFrame:
    """(rule, n): days that come more than once, rows without a price, at or below 0, or with high and low inside of the others. Rows broken in several ways count for the first."""
    gone, low = F.lit(False), F.lit(False)
    for c in OHLC:
        gone |= F.col(c).isNull() | F.isnan(c)
        low |= F.col(c) <= 0
    rule = F.when(gone, "missing").when(low, "nonpositive").when(~ohlc_ok(), "bounds")
    rows = bars.groupBy("d").agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(rule == r, F.lit(False))).alias(r) for r in ("missing", "nonpositive", "bounds")])
    counts = rows.agg(F.count_if(F.col("n") > 1).alias("repeated"), *[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in ("missing", "nonpositive", "bounds")])
    return counts.unpivot([], ["repeated", "missing", "nonpositive", "bounds"], "rule", "n").where("n > 0")


def checked_chart(bars: DataFrame) -> DataFrame:
    found = {r.rule: r.n for r in chart_faults(bars).collect()}
    if found:
        raise ValueError(f"chart: {found}")
    return bars


def pair_rates(payloads: DataFrame, series: str, column: str = "payload", unit: str = "Percent") -> DataFrame:
    """(d, rate) of payloads {series: {metadata, timeseries: {aggregation: [[day, value], ...]}}}. Another series, mnemonic or unit, and a pair that can't be read, end the job."""
    read = payloads.select(F.from_json(column, PAIRS).alias("_p"))
    of = F.col("_p")[F.lit(series)]
    wrong = F.coalesce(F.map_keys("_p") != F.array(F.lit(series)), F.lit(True)) | F.coalesce(of["metadata"]["mnemonic"] != series, F.lit(True)) | F.coalesce(of["metadata"]["unit"]["name"] != unit, F.lit(True))
    pairs = read.select(F.when(wrong, F.raise_error(f"rates: not the series {series} in {unit}").cast("array<array<string>>")).otherwise(of["timeseries"]["aggregation"]).alias("_pairs")).select(F.explode("_pairs").alias("_pair"))
    day, value = F.expr("try_cast(get(_pair, 0) as date)"), F.expr("try_cast(get(_pair, 1) as double)")
    rows = pairs.select(day.alias("d"), value.alias("rate"))
    return rows.withColumn("rate", _stops("rate", "double", F.col("d").isNull() | F.col("rate").isNull(), "rates: a pair that isn't a day and a number"))


def monthly_rates(raw: DataFrame, key: str, unit: str = "PCPA", collection: str = "A") -> DataFrame:
    """(month, rate) of a raw table KEY, UNIT, COLLECTION, TIME_PERIOD, OBS_VALUE as text. Another series, unit or collection ends the job, and so does a value that is no number or a month that comes twice."""
    missing = [c for c in ("KEY", "UNIT", "COLLECTION", "TIME_PERIOD", "OBS_VALUE") if c not in raw.columns]
    if missing:
        raise ValueError(f"series without {missing}")
    other = F.coalesce(F.col("KEY") != key, F.lit(False)) | F.coalesce(F.col("UNIT") != unit, F.lit(False)) | F.coalesce(F.col("COLLECTION") != collection, F.lit(False))
    month, value = F.expr("try_cast(concat(TIME_PERIOD, '-01') as date)"), F.expr("try_cast(OBS_VALUE as double)")
    rows = raw.select(month.alias("month"), value.alias("rate"), other.alias("_other"))
    rows = rows.withColumn("rate", _stops("rate", "double", F.col("_other") | F.col("month").isNull() | F.col("rate").isNull(), "series: another key, unit or collection, or a value that can't be read"))
    once = rows.groupBy("month").agg(F.max("rate").alias("rate"), F.count("*").alias("_n"))
    return once.select("month", _stops("rate", "double", F.col("_n") > 1, "series: a month comes twice").alias("rate"))


def benchmark_closes(raw: DataFrame) -> DataFrame:
    """(d, close) of a loose table: columns date or session_date and close, in any case; what is no number is left out, and a day that comes more than once is left out with all its rows."""
    names = dict(zip(plain_names(raw.columns), raw.columns, strict=True))
    day = names.get("date") or names.get("session_date")
    if day is None or "close" not in names:
        raise ValueError(f"no day or no close among {raw.columns}")
    rows = raw.select(F.expr(f"try_cast(`{day}` as date)").alias("d"), F.expr(f"try_cast(`{names['close']}` as double)").alias("close")).where("d is not null and close is not null and not isnan(close)")
    return rows.groupBy("d").agg(F.count("*").alias("_n"), F.max("close").alias("close")).where("_n = 1").select("d", "close")


def csv_dates(raw: DataFrame, day: str, numbers: list[str], pattern: str | None = None) -> DataFrame:
    """raw text columns with `day` as a date, by `pattern` if given, and `numbers` as doubles; rows whose day can't be read are an error that ends the job, numbers that can't be read are null."""
    parsed = F.expr(f"try_cast(`{day}` as date)") if pattern is None else F.to_date(F.try_to_timestamp(F.col(f"`{day}`"), F.lit(pattern)))
    rows = raw.withColumn("_d", parsed)
    rows = rows.withColumn("_d", _stops("_d", "date", F.col("_d").isNull(), f"{day}: a row without a day"))
    return rows.select(*[F.col("_d").alias(c) if c == day else F.expr(f"try_cast(`{c}` as double)").alias(c) if c in numbers else F.col(f"`{c}`") for c in raw.columns])
