"""Operators called as a library: policies, errors, files, daylight saving, a session by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import times
from tickloom.operators import cleaning, inference, sessions
from tickloom.sources import tables


def test_tables_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, 1 / 3, "a"), (2, None, "b")], "k int, x double, cell_id string")
    for suffix in ("parquet", "csv"):
        tables.write_table(df, f"{tmp_path}/t.{suffix}")
        back = tables.read_table(spark, f"{tmp_path}/t.{suffix}", ["k", "x"], None if suffix == "parquet" else "k int, x double, cell_id string")
        assert sorted(back.collect())[1] == (2, None) and math.isclose(sorted(back.collect())[0].x, 1 / 3, rel_tol=1e-11)
    tables.write_table(df.limit(0), f"{tmp_path}/none.csv")
    assert tables.read_table(spark, f"{tmp_path}/none.csv").count() == 0
    one = tables.of_cell(tables.read_table(spark, f"{tmp_path}/t.parquet"), "a")
    assert one.count() == 1 and "EqualTo(cell_id,a)" in one._jdf.queryExecution().toString()
    for f in (tables.read_table, lambda s, p: tables.write_table(df, p)):
        with pytest.raises(ValueError):
            f(spark, f"{tmp_path}/t.xls")


def test_names(spark):
    assert tables.plain_names([" Event Time (UTC)", "A--b"]) == ["event_time_utc", "a_b"]
    df = spark.createDataFrame([(1, 2)], "Ticker int, other int")
    assert tables.resolved(df, {"symbol": ["ticker"], "x": ["y"]}, ["symbol"]).columns == ["symbol"]
    with pytest.raises(ValueError):
        tables.resolved(df, {"symbol": ["sym"]}, ["symbol"])
    with pytest.raises(ValueError):
        tables.of_symbol(df.select(F.lit("spy").alias("symbol")), "QQQ")


@pytest.mark.parametrize("number, unit", [(1_700_000_000, "s"), (1_700_000_000_000, "ms"), (1_700_000_000_000_000, "us"), (1_700_000_000_000_000_000, "ns")])
def test_epoch_units(spark, number, unit):
    df = spark.createDataFrame([(number,)], "t long")
    assert times.epoch_unit(df, "t") == unit
    assert times.parsed(df, "t").first().t == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_daylight_saving(spark):
    """02:30 is skipped on 10 March 2024 and 01:30 comes twice on 3 November 2024."""
    rows = ["2024-03-10 01:59:00", "2024-03-10 02:30:00", "2024-03-10 03:00:00", "2024-11-03 01:30:00", "2024-11-03 00:59:00", "2024-11-03 02:00:00", "bad"]
    got = [r.t for r in times.parsed(spark.createDataFrame([(t,) for t in rows], "t string").coalesce(1), "t", "America/New_York").collect()]
    assert got == [dt.datetime(2024, 3, 10, 6, 59), None, dt.datetime(2024, 3, 10, 7), None, dt.datetime(2024, 11, 3, 4, 59), dt.datetime(2024, 11, 3, 7), None]
    mixed = spark.createDataFrame([("2024-01-02T10:00:00+02:00",), ("2024-01-02 10:00:00",)], "t string").coalesce(1)
    assert [r.t for r in times.parsed(mixed, "t", "America/New_York").collect()] == [dt.datetime(2024, 1, 2, 8), dt.datetime(2024, 1, 2, 15)]
    with pytest.raises(ValueError):
        times.parsed(spark.createDataFrame([(1_700_000_000,)], "t long"), "t", unit="ms")
    with pytest.raises(ValueError):
        times.localized(F.lit("2024-01-01").cast("timestamp_ntz"), "")


def test_duplicate_policies(spark):
    df = spark.createDataFrame([(1, 1.0, 1, "a"), (1, 1.0, 2, "b"), (2, 5.0, 3, "b"), (2, None, 4, "a"), (3, None, 5, "a")], "k int, v double, pos int, src string")
    assert [tuple(r) for r in cleaning.conflicts(df, "k", ["v"]).collect()] == [(2, 2, 2)]
    by = lambda *a: {r.k: (r.v, r.src) for r in cleaning.resolved(df, "k", ["v"], *a).collect()}
    assert by("last", "pos") == {1: (1.0, "b"), 2: (None, "a"), 3: (None, "a")}
    assert by("source", "pos", "src", ["b", "a"]) == {1: (1.0, "b"), 2: (5.0, "b"), 3: (None, "a")}
    for args in (("error", "pos"), ("identical", "pos"), ("other", "pos"), ("source", "pos", "src", ["b"])):
        with pytest.raises(ValueError):
            by(*args)
    cash = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 1), 2.0), (None, 9.0)], "d date, amount double")
    assert [tuple(r)[1:] for r in cleaning.dividends(cash, "sum").collect()] == [(3.0, 2)] and cleaning.dividends(cash, "first").first().amount == 1.0
    with pytest.raises(ValueError):
        cleaning.dividends(cash)


def test_session_grades(spark):
    """A session of 10 minutes, halted at 4 and 5, under all grades."""
    days = {1: range(1, 11), 2: [m for m in range(1, 11) if m not in (4, 5)], 3: [], 4: [1, 2, 3], 5: [*range(3, 11)], 6: [1, 2, 3, 6, 9, 10], 7: [*range(1, 11), 12], 8: range(1, 11)}
    date = lambda k: dt.date(2024, 1, k)
    bars = spark.createDataFrame([(date(k), m, 1) for k, ms in days.items() for m in ms], "d date, m int, volume int")
    schedule = spark.createDataFrame([(date(k), 10) for k in days], "d date, bars int")
    opens = schedule.withColumn("opens", F.col("d").cast("timestamp"))
    windows = spark.createDataFrame([(date(k), f"2024-01-0{k} 00:03:30", f"2024-01-0{k} 00:04:00") for k in (2, 8)], "d date, s string, e string").select("d", F.to_timestamp("s").alias("starts"), F.to_timestamp("e").alias("ends"))
    halts = sessions.halt_minutes(opens, windows)
    assert sorted(r.m for r in halts.where("day(d) = 2").collect()) == [4, 5]
    got = {r.d.day: r for r in sessions.graded(sessions.diagnostics(bars, schedule, halts)).collect()}
    assert {k: r.quality for k, r in got.items()} == {1: "complete", 2: "halt_adjusted", 3: "absent", 4: "sparse", 5: "truncated", 6: "interior_gap", 7: "halt_anomaly", 8: "halt_anomaly"}
    assert not got[5].open_valid and got[5].close_valid and got[1].paper_ready and got[2].halt_usable and not got[2].paper_ready and got[6].exploratory
    assert sessions.longest_run(spark.createDataFrame([(k, k in (2, 3, 5)) for k in range(7)], "k int, gone boolean"), "gone", "k").first()[0] == 2


def test_inference_helpers(spark):
    assert inference.seed_of(1, "circular", 20, "full") == inference.seed_of(1, "circular", 20, "full") != inference.seed_of(1, "circular", 20, "pre")
    assert inference.seed_of(7, "circular", 20, "pre") == int.from_bytes(bytes.fromhex("821e5a1fcf1118d0"), "little")
