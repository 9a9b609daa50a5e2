"""Schedules, curves and payloads called as a library: each way in which an input can be wrong, and edges by hand."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickloom.operators import curves, schedules
from tickloom.sources import payloads

SITE = "https://rates.example/"
D = dt.date.fromisoformat
ROWS = [["2020-01-01", "2020-06-30", "10", "0.00001", SITE, ""], ["2020-07-01", "2020-12-31", "0", "0", SITE, None], ["2021-01-01", None, "20.6", "0.0000206", SITE, ""]]


def raw(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in schedules.COLUMNS))


def changed(row, column, value):
    rows = [list(r) for r in ROWS]
    rows[row][column] = value
    return rows


@pytest.mark.parametrize(
    "rule, rows",
    [
        ("rows", []), ("start", changed(1, 0, "soon")), ("repeated_start", [*ROWS, ROWS[2]]), ("open_end", changed(0, 1, None)), ("rate", changed(0, 2, "-10")), ("rate", changed(0, 2, "inf")), ("rate", changed(2, 3, None)),
        ("decimal", changed(2, 3, "0.0000207")), ("reversed", changed(0, 1, "2019-12-31")), ("contiguous", changed(0, 1, "2020-06-29")), ("contiguous", changed(0, 1, "2020-07-01")), ("source", changed(1, 4, "http://rates.example/")), ("source", changed(1, 4, None)),
    ],
)
def test_a_broken_schedule_is_refused(spark, rule, rows):
    with pytest.raises(ValueError, match=rule):
        schedules.checked(raw(spark, rows), SITE)


def test_schedule_of_a_fact(spark):
    with pytest.raises(ValueError, match="notes"):
        schedules.checked(raw(spark, ROWS).drop("notes"), SITE)
    s = schedules.checked(raw(spark, ROWS), SITE)
    days = ["2019-12-31", "2020-01-01", "2020-06-30", "2020-07-01", "2020-12-31", "2021-01-01", "2199-01-01", None]
    facts = spark.createDataFrame([(D(x) if x else None, i) for i, x in enumerate(days)] + [(D("2020-07-01"), 99)], "day date, rate_per_million int")
    for width in (1, 32, 10_000):
        got = {r.rate_per_million: r.rate_decimal for r in schedules.effective(facts, s, "day", width=width).collect()}
        assert got == {0: None, 1: 1e-5, 2: 1e-5, 3: 0.0, 4: 0.0, 5: 2.06e-5, 6: 2.06e-5, 7: None, 99: 0.0}
    assert {(r.day, r.n) for r in schedules.uncovered(facts, s, "day").collect()} == {(D("2019-12-31"), 1), (None, 1)}
    assert schedules.covered(facts.where("day >= '2020-01-01'"), s, "day").count() == 7
    with pytest.raises(PySparkException, match="schedule misses 2019-12-31"):
        schedules.covered(facts, s, "day").orderBy("day").where("day is not null").collect()
    keyed = s.withColumn("k", F.lit("a")).unionByName(s.where("effective_to is not null").withColumn("k", F.lit("b")))
    both = facts.crossJoin(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"))
    got = {(r.k, r.rate_per_million): r.rate_decimal for r in schedules.effective(both, keyed, "day", keys=("k",)).collect()}
    assert len(got) == 27 and got["a", 6] == 2.06e-5 and got["b", 6] is None and got["b", 99] == 0 and got["c", 99] is None


def test_keyed_schedules_are_judged_apart(spark):
    two = raw(spark, ROWS).withColumn("k", F.lit("a")).unionByName(raw(spark, ROWS).withColumn("k", F.lit("b")))
    assert schedules.checked(two, SITE, ("k",)).count() == 6
    with pytest.raises(ValueError, match="repeated_start"):
        schedules.checked(two, SITE)


def test_asof_before_carries_across_periods(spark):
    day = lambda n: D("2024-01-01") + dt.timedelta(n)
    left = spark.createDataFrame([(day(n), k) for n in (0, 1, 2, 40, 41, 41, 200) for k in "ab"] + [(None, "a"), (day(5), None)], "d date, k string").withColumn("rate", F.lit("clash")).drop("rate")
    right = spark.createDataFrame([(day(1), 1.0, "a"), (day(41), 2.0, "a"), (day(0), 9.0, "b")], "d date, rate double, k string")
    got = sorted(((r.k, (r.d - day(0)).days, r.rate) for r in curves.asof_before(left, right, keys=("k",)).where("d is not null and k is not null").collect()), key=str)
    want = [("a", 0, None), ("a", 1, None), ("a", 2, 1.0), ("a", 40, 1.0), ("a", 41, 1.0), ("a", 41, 1.0), ("a", 200, 2.0), ("b", 0, None), *[("b", n, 9.0) for n in (1, 2, 40, 41, 41, 200)]]
    assert got == sorted(want, key=str) and curves.asof_before(left, right, keys=("k",)).count() == left.count()
    assert {r.rate for r in curves.asof_before(left, right.limit(0), keys=("k",)).collect()} == {None}


def curve_inputs(spark):
    sessions = spark.createDataFrame([(D(x),) for x in ("2023-06-15", "2023-06-30", "2023-07-03", "2023-07-04", "2023-07-20")], "d date")
    monthly = spark.createDataFrame([(D("2023-05-01"), 5.0)], "month date, rate double")
    daily = spark.createDataFrame([(D("2023-07-02"), 4.0), (D("2023-07-03"), 4.5)], "d date, rate double")
    return sessions, monthly, daily


def test_curve_of_two_segments(spark):
    sessions, monthly, daily = curve_inputs(spark)
    rows = {str(r.d): r for r in curves.point_in_time(sessions, monthly, daily, "2023-06-30", "2023-07-03", -10, 100, 25).collect()}
    assert [rows[d].benchmark_rate_percent for d in sorted(rows)] == [5.0, 5.0, 4.0, 4.5, 4.5]
    assert rows["2023-06-15"].observation == "2023-05" and rows["2023-07-20"].observation == "2023-07-03" and rows["2023-07-20"].age == 17
    assert abs(rows["2023-06-30"].cash_rate_annual - 0.049) < 1e-12 and abs(rows["2023-06-30"].funding_rate_annual - 0.06) < 1e-12 and rows["2023-06-30"].borrow_rate_annual == 0.0025
    whole = curves.point_in_time(sessions, monthly, daily, "2023-06-30", "2023-07-03")
    assert curves.checked_curve(whole, sessions).count() == 5
    for wrong, rule in (
        (whole.where("d <> '2023-07-04'"), "missing_session"), (whole.unionByName(whole.limit(1)), "repeated_session"), (whole.withColumn("d", F.date_add("d", 1)), "unknown_session"),
        (curves.point_in_time(sessions, monthly, daily, "2023-06-30", "2023-07-03", stale_days=5), "rate"), (curves.point_in_time(sessions, monthly, daily, "2023-06-30", "2023-07-04"), "rate"), (curves.point_in_time(sessions, monthly.limit(0), daily, "2023-06-30", "2023-07-03"), "rate"),
        (whole.withColumn("cash_rate_annual", F.lit(float("inf"))), "rate"),
    ):
        with pytest.raises(ValueError, match=rule):
            curves.checked_curve(wrong, sessions)
    with pytest.raises(ValueError, match="daily segment"):
        curves.point_in_time(sessions, monthly, daily, "2023-07-03", "2023-07-03")
    with pytest.raises(ValueError, match="without"):
        curves.checked_curve(whole.drop("cash_rate_annual"), sessions)


def texts(spark, *xs):
    return spark.createDataFrame([(x if isinstance(x, str) or x is None else json.dumps(x),) for x in xs], "payload string")


def chart(stamps, **columns):
    quote = {c: columns.get(c, [10.0] * len(stamps)) for c in (*payloads.OHLC, "volume")}
    return {"chart": {"error": None, "result": [{"timestamp": stamps, "indicators": {"quote": [quote]}}]}}


def test_chart_payloads(spark):
    """1,700,000,000 s is 17:13 in New York on 14 November 2023; 04:30 UTC is the day before there."""
    early = 1_699_936_200
    bars = payloads.chart_bars(texts(spark, chart([1_700_000_000, early], high=[12, 11.5]), chart([1_700_100_000], volume=[None])))
    assert sorted((str(r.d), r.high) for r in bars.collect()) == [("2023-11-13", 11.5), ("2023-11-14", 12.0), ("2023-11-15", 10.0)]
    assert payloads.checked_chart(bars).count() == 3 and payloads.chart_bars(texts(spark)).count() == 0
    for wrong in ({"chart": {"error": "no such symbol", "result": None}}, {"other": 1}, "not json", None, chart([1, 2], close=[1.0])):
        with pytest.raises(PySparkException, match="chart: "):
            payloads.chart_bars(texts(spark, wrong)).collect()
    stamp = [1_700_000_000]
    for columns, rule in (({"close": [None]}, "missing"), ({"open": [0.0]}, "nonpositive"), ({"high": [9.0]}, "bounds"), ({"low": [11.0]}, "bounds")):
        with pytest.raises(ValueError, match=rule):
            payloads.checked_chart(payloads.chart_bars(texts(spark, chart(stamp, **columns))))
    with pytest.raises(ValueError, match="repeated"):
        payloads.checked_chart(payloads.chart_bars(texts(spark, chart(stamp), chart(stamp))))


def pairs(series="SOFR", mnemonic="SOFR", unit="Percent", rows=(("2024-01-02", 5.31), ("2024-01-03", 5.3))):
    return {series: {"metadata": {"mnemonic": mnemonic, "unit": {"name": unit}}, "timeseries": {"aggregation": [list(r) for r in rows]}}}


def test_pair_payloads(spark):
    assert sorted((str(r.d), r.rate) for r in payloads.pair_rates(texts(spark, pairs()), "SOFR").collect()) == [("2024-01-02", 5.31), ("2024-01-03", 5.3)]
    for wrong in (pairs("OTHER"), {**pairs(), "MORE": pairs()["SOFR"]}, pairs(mnemonic="X"), pairs(unit="Basis points"), pairs(rows=[("2024-01-02", None)]), pairs(rows=[("soon", 5.0)]), "no json"):
        with pytest.raises(PySparkException, match="rates: "):
            payloads.pair_rates(texts(spark, wrong), "SOFR").collect()


def test_monthly_series(spark):
    row = ("K", "PCPA", "A", "2024-01", "5.5")
    series = lambda *rows: payloads.monthly_rates(spark.createDataFrame(list(rows), "KEY string, UNIT string, COLLECTION string, TIME_PERIOD string, OBS_VALUE string"), "K")
    assert [tuple(r) for r in series(row).collect()] == [(D("2024-01-01"), 5.5)]
    for k, value in ((0, "L"), (1, "PC"), (2, "E"), (3, "Q1"), (4, "n/a")):
        with pytest.raises(PySparkException, match="series: "):
            series(tuple(value if i == k else x for i, x in enumerate(row))).collect()
    with pytest.raises(PySparkException, match="twice"):
        series(row, row).collect()
    with pytest.raises(ValueError):
        payloads.monthly_rates(spark.createDataFrame([("K",)], "KEY string"), "K")


def test_loose_closes_and_dates(spark):
    raw_ = spark.createDataFrame([("2024-01-02", "10"), ("2024-01-03", "11"), ("2024-01-03", "11"), ("2024-01-04", "x"), ("2024-01-04", "12"), (None, "9")], "`DATE` string, `Close ` string")
    assert sorted((str(r.d), r.close) for r in payloads.benchmark_closes(raw_).collect()) == [("2024-01-02", 10.0), ("2024-01-04", 12.0)]
    with pytest.raises(ValueError):
        payloads.benchmark_closes(raw_.drop("DATE"))
    text = spark.createDataFrame([("01/02/2024", "1.5", "a"), ("02/02/2024", "x", "b")], "day string, v string, other string")
    assert [tuple(r) for r in payloads.csv_dates(text, "day", ["v"], "dd/MM/yyyy").orderBy("day").collect()] == [(D("2024-02-01"), 1.5, "a"), (D("2024-02-02"), None, "b")]
    with pytest.raises(PySparkException, match="without a day"):
        payloads.csv_dates(text, "day", ["v"]).collect()
