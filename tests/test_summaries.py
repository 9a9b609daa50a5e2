"""Exchange schedules and summaries by variant and period, by hand and in their failures."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException

from tickloom.operators import exchange, summaries


def days(spark, *d):
    return spark.createDataFrame([(dt.date.fromisoformat(x) if x else None,) for x in d], "d date")


def test_schedule_moves_with_daylight_saving(spark):
    """8 March 2024 is before the change of clocks, 11 March after it; 9 March is a Saturday, 29 March a holiday, 3 July ends at 13:00."""
    d = days(spark, "2024-03-08", "2024-03-09", "2024-03-11", "2024-03-11", "2024-03-29", "2024-07-03", "2024-11-04", None)
    early = spark.createDataFrame([(dt.date(2024, 7, 3), "13:00"), (dt.date(2024, 7, 4), "13:00")], "d date, closes string")
    got = {str(r.d): (r.open.strftime("%H:%M"), r.close.strftime("%H:%M"), r.minutes, r.early) for r in exchange.schedule(d, days(spark, "2024-03-29", None), early).collect()}
    assert got == {"2024-03-08": ("14:30", "21:00", 390, False), "2024-03-11": ("13:30", "20:00", 390, False), "2024-07-03": ("13:30", "17:00", 210, True), "2024-11-04": ("14:30", "21:00", 390, False)}
    assert exchange.schedule(d.limit(0), d, early).count() == 0


@pytest.mark.parametrize("rows", [[("2024-07-03", "09:00")], [("2024-07-03", "13:00"), ("2024-07-03", "14:00")]])
def test_bad_early_ends_stop_the_job(spark, rows):
    early = spark.createDataFrame(rows, "d string, closes string").selectExpr("d::date AS d", "closes")
    with pytest.raises(PySparkException, match="broken rule"):
        exchange.schedule(days(spark, "2024-07-03"), days(spark), early).collect()


def test_costs_by_kind(spark):
    x = spark.createDataFrame([("a", 1.0, 3.0, 100.0), ("a", None, 4.0, 100.0), ("b", 0.0, 0.0, 0.0)], "v string, fee double, slip double, notional double")
    got = {(r.v, r.kind): (r.cost, r.share, r.bps and round(r.bps, 6)) for r in summaries.costs(x, ("v",), ("fee", "slip")).collect()}
    assert got == {("a", "fee"): (1.0, 0.125, 50.0), ("a", "slip"): (7.0, 0.875, 350.0), ("b", "fee"): (0.0, None, None), ("b", "slip"): (0.0, None, None)}


def test_bands_include_their_lower_edge(spark):
    rows = [(0.5, 0.01, 1.0), (1.0, -0.01, 2.0), (1.99, 0.03, 3.0), (2.0, 0.0, 2.0), (9.0, 0.02, 2.0), (None, 0.1, 0.0), (float("nan"), 0.1, 0.0)]
    x = spark.createDataFrame(rows, "lev double, ret double, net double")
    got = {r.band: (r.sessions, r.net, round(r.mean_bp, 6), r.hit, r.share) for r in summaries.by_band(x, (), "lev", (1.0, 2.0)).collect()}
    assert got == {0: (1, 1.0, 100.0, 1.0, 0.1), 1: (2, 5.0, 100.0, 0.5, 0.5), 2: (2, 4.0, 100.0, 0.5, 0.4), None: (2, 0.0, 1000.0, 1.0, 0.0)}
    with pytest.raises(ValueError, match="rise"):
        summaries.band(x.lev, (2.0, 1.0))


def test_identity_counts_unknown_rows(spark):
    x = spark.createDataFrame([("a", 5.0, 8.0, 3.0), ("a", 5.5, 8.0, 3.0), ("a", None, 8.0, 3.0), ("b", 1.0, 1.0, None)], "g string, net double, gross double, cost double")
    got = {r.g: (r.rows, r.off, r.unknown, r.most) for r in summaries.identity(x, ("g",), "net", {"gross": 1, "cost": -1}, 0.1).collect()}
    assert got == {"a": (3, 1, 1, 0.5), "b": (1, 0, 1, None)}


def test_statuses_in_order(spark):
    x = spark.createDataFrame([("p", "z"), ("p", "a"), ("p", "a"), ("p", "fine"), ("q", "fine"), ("q", None)], "g string, s string")
    assert {r.g: r.statuses for r in summaries.statuses(x, ("g",), "s", ("z", "a", "m")).collect()} == {"p": "a,z", "q": ""}


def test_quintile_table(spark):
    rows = [(k, float(k), k / 1e4, "pre" if k < 10 else "post") for k in range(20)] + [(20, None, 1.0, "pre"), (21, 1.0, 1.0, "other")]
    x = spark.createDataFrame(rows, "d int, vol double, r double, w string")
    got = {r.quintile: (r.pre_sessions, round(r.pre_bp, 6), r.post_sessions, round(r.post_bp, 6), round(r.change, 6)) for r in summaries.quintile_table(x, "vol", "r", "w", "pre", "post").collect()}
    assert got == {q: (2, 2 * q - 1.5, 2, 2 * q + 8.5, 10.0) for q in range(1, 6)}
