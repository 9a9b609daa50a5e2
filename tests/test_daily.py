"""Sessions by the clock, raw prices, exits from outside and naive sessions, by hand and in their failures."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException

from tickloom.operators import daily as D

DAY = dt.date(2024, 3, 4)


def later(n):
    return DAY + dt.timedelta(n)


def test_clock_range_includes_both_ends(spark):
    at = lambda *t: dt.datetime(2024, 3, 4, *t)
    rows = [(1, at(9, 29, 59)), (2, at(9, 30)), (3, at(12, 0)), (4, at(15, 59)), (5, at(15, 59, 0, 1)), (6, at(15, 59, 30)), (7, None)]
    x = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    assert sorted(r.id for r in D.clock_range(x).collect()) == [2, 3, 4]
    assert D.clock_range(x.limit(0)).count() == 0


def test_session_bars_skip_nulls(spark):
    rows = [(DAY, 1, None, 5.0, 1.0, 2.0, 10), (DAY, 2, 3.0, 9.0, 2.0, 4.0, None), (DAY, 3, 4.0, None, None, None, 5), (later(1), 1, None, None, None, None, None)]
    x = spark.createDataFrame(rows, "d date, m int, open double, high double, low double, close double, volume long")
    got = {r.d: (r.open, r.high, r.low, r.close, r.volume) for r in D.session_bars(x, ("d",), ("m",), volume=x.volume).collect()}
    assert got == {DAY: (3.0, 9.0, 1.0, 4.0, 15), later(1): (None, None, None, None, 0)}


def test_last_line_of_a_date_counts(spark):
    lines = [(1, "2024-03-04", "1.5"), (2, "2024-03-04", "x"), (3, "2024-03-04", "2.5"), (4, "2024-03-05", "NaN"), (5, None, "1"), (6, "2023-12-31", "1"), (7, "2024-12-31", "7"), (8, "2025-01-01", "8"), (9, "4 March", "9")]
    x = spark.createDataFrame(lines, "pos int, DATE string, Dividend string")
    got = {str(r.d): r.amount for r in D.dividends_of_file(x, "pos", "2024-01-01", "2024-12-31").collect()}
    assert got == {"2024-03-04": 2.5, "2024-12-31": 7.0}
    with pytest.raises(ValueError, match="dividend"):
        D.dividends_of_file(x.drop("Dividend"), "pos", "2024-01-01", "2024-12-31")


def test_raw_prices_by_symbol(spark):
    """a falls by its dividend and is raw; b doesn't fall and is adjusted; c has no ex-date with a close before it."""
    rows = [(s, later(k), o, 100.0) for s, opens in (("a", (100.0, 100.0, 98.0, 100.0)), ("b", (100.0, 100.0, 100.0, 100.0)), ("c", (100.0, 101.0))) for k, o in enumerate(opens)]
    days = spark.createDataFrame(rows, "s string, d date, open double, close double")
    cash = spark.createDataFrame([("a", later(2), 1.0), ("a", later(2), 1.0), ("a", later(40), 9.0), ("b", later(2), 2.0), ("c", DAY, 5.0)], "s string, d date, amount double")
    got = {r.s: r for r in D.raw_price_evidence(days, cash, ("s",)).collect()}
    assert {s: (r.ex_dates, r.supports_raw) for s, r in got.items()} == {"a": (1, True), "b": (1, False), "c": (0, None)}
    assert (round(got["a"].ex_gap, 6), round(got["a"].ex_gap_added, 6), round(got["a"].residual_raw, 6)) == (-2.0, 0.0, -2.0)
    assert round(got["c"].other_gap, 6) == 1.0 and got["c"].ex_gap is None
    whole = D.raw_price_evidence(days.where("s = 'a'").drop("s"), cash.where("s = 'a'").drop("s")).collect()
    assert [(r.ex_dates, r.supports_raw) for r in whole] == [(1, True)]
    assert D.raw_price_evidence(days, cash.limit(0), ("s",)).where("supports_raw is not null").count() == 0


def test_exits_from_outside(spark):
    days = spark.createDataFrame([(DAY, 10.0), (later(1), 11.0), (later(2), None)], "d date, price double")
    given = spark.createDataFrame([(later(1), "11.5", "0.02")], "d date, price string, extra_cost_per_share string")
    got = {r.d: (r.price, r.cost, r.given) for r in D.exits(days, D.exit_overrides(given)).collect()}
    assert got == {DAY: (10.0, 0.0, False), later(1): (11.5, 0.02, True), later(2): (None, 0.0, False)}
    assert [r.cost for r in D.exit_overrides(given.drop("extra_cost_per_share")).collect()] == [0.0]
    with pytest.raises(ValueError, match="price"):
        D.exit_overrides(given.drop("price"))


@pytest.mark.parametrize("rows", [[(DAY, "1", "0"), (DAY, "1", "0")], [(None, "1", "0")], [(DAY, "0", "0")], [(DAY, "-1", "0")], [(DAY, "Infinity", "0")], [(DAY, "NaN", "0")], [(DAY, "x", "0")], [(DAY, None, "0")], [(DAY, "1", "-0.1")], [(DAY, "1", None)], [(DAY, "1", "NaN")]])
def test_bad_exits_stop_the_job(spark, rows):
    with pytest.raises(PySparkException, match="broken rule"):
        D.exit_overrides(spark.createDataFrame(rows, "d date, price string, extra_cost_per_share string")).collect()


def test_session_results(spark):
    """Long from minute 2, flat at 4, short to the end: units 1 + 1 + 1 + 1. 25.5 and 24.5 shares are both rounded to even."""
    minutes = spark.createDataFrame([(DAY, m, e, p) for m, e, p in ((1, 0, None), (2, 1, 0.5), (3, 1, 1.0), (4, 0, 0.0), (5, -1, -0.25))] + [(later(1), 1, 0, None)], "d date, m int, exposure int, pnl double")
    days = spark.createDataFrame([(DAY, 100.0, 0.02), (later(1), 100.0, None), (later(2), None, 0.02)], "d date, day_open double, vol double")
    got = {r.d: r for r in D.session_results(minutes, days, aum=2550.0, target=0.02, most=2.0, null_vol="max").collect()}
    assert {d: (r.shares, r.units) for d, r in got.items()} == {DAY: (26, 4), later(1): (51, 0)}
    r = got[DAY]
    assert (round(r.gross, 6), round(r.commission, 6), round(r.net, 6)) == (32.5, 1.4, 31.1) and round(r.ret, 8) == round(31.1 / 2550, 8)
    assert D.session_results(minutes, days, aum=2450.0, target=0.02, most=2.0).where("d = DATE '2024-03-04'").first().shares == 24


def test_evaluated_returns_and_sharpe(spark):
    rows = [(DAY, "active", 0.01), (later(1), "zero_size", None), (later(2), "unknown_exit", 0.5), (later(3), "warmup_no_band", 0.5), (later(4), None, 0.5), (later(5), "active", 0.02)]
    x = D.evaluation(spark.createDataFrame(rows, "d date, status string, ret double"))
    assert {r.d: (r.is_evaluation, r.ret) for r in x.collect() if not r.is_evaluation} == {later(k): (False, None) for k in (2, 3, 4)}
    one = D.calendar_sharpe(x, (), 0.252).first()
    assert one.sessions == 3 and round(one.sharpe, 6) == round((0.01 - 0.001) / 0.01 * 252**0.5, 6)
    assert D.calendar_sharpe(x.where("d <= DATE '2024-03-04'"), ()).first().sharpe is None


def test_break_even(spark):
    rows = [("pre", "base", 5.0), ("pre", "half", 6.0), ("pre", "one", 4.0), ("post", "base", 5.0), ("post", "half", 5.0), ("post", "one", 3.0), ("none", "base", 5.0), ("none", "half", 6.0)]
    x = spark.createDataFrame(rows, "period string, variant string, cagr double")
    got = {r.period: r.bps for r in D.break_even(x, ("period",), "variant", "cagr", "base", ("half", 0.5), ("one", 1.0)).collect()}
    assert got == {"pre": 0.75, "post": 0.5, "none": None}


def test_selection_and_top(spark):
    x = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, "b", 2.0), (4, None, 9.0)], "id int, c string, v double")
    assert sorted(r.id for r in D.matching(x, c="a", id=None).collect()) == [1, 2] and D.matching(x).count() == 4
    with pytest.raises(ValueError, match="nope"):
        D.matching(x, nope=None)
    assert [r.id for r in D.top(x, "v", ("id",), 3).collect()] == [4, 1, 3] and [r.id for r in D.top(x, "v", ("id",)).collect()][-1] == 2
