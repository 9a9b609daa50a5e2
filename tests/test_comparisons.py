"""Sizing, benchmarks, regimes and files by hand: policies, wrong arguments, edges."""

import datetime as dt
import math

import pyarrow as pa
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from tickloom.operators import benchmarks, performance, regimes, sessions, sizing
from tickloom.operators import features as X
from tickloom.plans import catalogue
from tickloom.sources import tables
from tests.compare import same

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(n)


def test_leverage_policies(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.001,), (0.0,), (None,), (float("nan"),)], "v double").coalesce(1)
    of = lambda **k: [r[0] for r in df.select(sizing.leverage(F.col("v"), **k)).collect()]
    assert of(target=0.02) == [2.0, 0.5, 4.0, 4.0, 0.0, 0.0] and of(target=0.02, null_vol="max", most=3.0) == [2.0, 0.5, 3.0, 3.0, 3.0, 3.0] and of(sizing="flat", flat=1.5) == [1.5] * 6
    for wrong in ({"sizing": "other"}, {"null_vol": "other"}, {"most": 0}, {"target": -1}):
        with pytest.raises(ValueError):
            sizing.leverage(F.col("v"), **wrong)
    with pytest.raises(ValueError):
        sizing.shares(F.lit(1.0), F.lit(1.0), F.lit(1.0), "up")


def test_shares_and_states(spark):
    one = spark.range(1)
    got = one.select(*[sizing.shares(F.lit(100.0), F.lit(40.0), F.lit(x), r).alias(f"{r}{k}") for r in sizing.ROUNDINGS for k, x in enumerate((1.0, 1.4, 0.1))], sizing.shares(F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("none")).first()
    # 2.5, 3.5 and 0.25 shares: halves go to even.
    assert tuple(got) == (2, 3, 0, 2, 4, 0, None)
    rows = spark.createDataFrame([(None, 1.0, 1.0, 5), (1.0, None, 1.0, 5), (1.0, 1.0, None, 5), (1.0, 1.0, 1.0, 0), (1.0, 1.0, 1.0, 5)], "p double, b double, v double, n int").coalesce(1)
    state = lambda **k: [r[0] for r in rows.select(sizing.state(F.col("p"), F.col("b"), F.col("v"), F.col("n"), **k)).collect()]
    assert state() == ["warmup_no_prev_close", "warmup_no_band", "invalid_feature_dvol", "zero_size", "active"] and state(null_vol="max")[2] == "active" and state(sizing="flat")[2] == "active"
    got = one.select(sizing.held_leverage(F.lit(600.0), F.lit(100.0), F.lit(3)).alias("a"), sizing.held_leverage(F.lit(600.0), F.lit(100.0), F.lit(0)).alias("b"), sizing.per_share(2, F.lit(50.0)).alias("c"), sizing.cell_id(F.lit("paper"), F.lit("strict"), slip=F.lit(0.0025)).alias("d"), sizing.evaluated(F.lit("zero_size")).alias("e"), sizing.evaluated(F.lit("unknown_exit")).alias("f")).first()
    assert tuple(got) == (2.0, None, 0.01, "paper__strict__slip_0p0025", True, False)


def test_two_sessions_a_day(spark):
    """A tick belongs to the session that opened last, of two on one day too, and comes once."""
    at = lambda n, h, m=0: dt.datetime(2024, 1, n, h, m)
    schedule = spark.createDataFrame([("a", at(1, 9), at(1, 11)), ("b", at(1, 13), at(1, 15)), ("c", at(3, 9), at(3, 11))], "d string, opens timestamp, closes timestamp")
    ticks = spark.createDataFrame([(t,) for t in (at(1, 8), at(1, 9), at(1, 12), at(1, 13), at(1, 14, 59), at(2, 0), at(3, 8), at(3, 10))], "ts timestamp")
    got = [(r.d, r.inside) for r in sessions.attached(ticks, schedule).orderBy("ts").collect()]
    assert got == [(None, False), ("a", True), ("a", False), ("b", True), ("b", True), ("b", False), ("b", False), ("c", True)]


def test_previous_close_less_its_dividend(spark):
    grid = spark.createDataFrame([(day(k), m, float(10 * k + m)) for k in range(3) for m in (1, 2)], "d date, m int, close double")
    paid = spark.createDataFrame([(day(1), 0.5), (day(1), 0.25), (day(9), 4.0)], "d date, amount double")
    got = {r.d: r.prev_close for r in X.with_previous_close(grid, paid).where("m = 1").collect()}
    assert got == {day(0): None, day(1): 1.25, day(2): 12.0}


def test_benchmark_policies(spark):
    closes = spark.createDataFrame([(day(0), 100.0, True), (day(1), 999.0, False), (day(2), 110.0, True), (day(3), 121.0, None), (day(4), 121.0, True)], "d date, close double, valid boolean")
    paid = spark.createDataFrame([(day(2), 1.1), (day(0), 2.0), (day(7), 5.0)], "d date, amount double")
    of = lambda **k: {(r.d - DAY).days: (r.price, r.total) for r in benchmarks.total_returns(closes, paid, **k).collect()}
    null = of()
    assert len(null) == 5 and all(x == (None, None) for x in null.values())
    drop = of(policy="drop")
    assert set(drop) == {0, 2, 4} and drop[0] == (None, None) and math.isclose(drop[2][0], 0.1) and math.isclose(drop[2][1], 0.111) and math.isclose(drop[4][1], 0.1)
    anchored = of(policy="drop", anchor=True)
    assert set(anchored) == {0, 2, 4} and anchored[0] == (0.0, pytest.approx(0.02))
    assert [r.d for r in benchmarks.off_calendar(closes, paid).collect()] == [day(7)]
    assert benchmarks.total_returns(closes.limit(0), paid, "drop", True).count() == 0
    with pytest.raises(ValueError):
        benchmarks.total_returns(closes, paid, "pad")
    starts = spark.createDataFrame([(day(0),), (day(3),), (day(30),)], "start date")
    assert {(r.start - DAY).days: r.close for r in benchmarks.anchor_before(closes, starts).collect()} == {0: None, 3: 110.0, 30: 121.0}


def test_figures_leave_out_days_without_a_benchmark(spark):
    s = spark.createDataFrame([(day(k), x, k != 4) for k, x in enumerate((0.01, None, 0.02, -0.01, 9.0))], "d date, ret double, evaluated boolean")
    b = spark.createDataFrame([(day(0), 0.02, 0.02), (day(2), 0.01, 0.015), (day(3), None, None)], "d date, price double, total double")
    r = benchmarks.figures(s, b).first()
    assert (r.sessions, r.valid, r.missing) == (4, 2, 2) and math.isclose(r.beta, 2 * (0.01 - 0.02) / (0.02 - 0.015))
    x = performance.reporting(s.select("d", "ret", F.lit(2.0).alias("cash_interest"), F.lit(100.0).alias("prev_aum"), F.lit("active").alias("status")).where("d < '2024-01-03'").withColumn("g", F.lit(1)), ("g",)).first()
    assert math.isclose(x.trading_total, -0.01) and math.isclose(x.cash_share, 2.0) and math.isclose(x.cash_annualised, 0.01 * 252)


def test_relative_wealth_by_hand(spark):
    r = benchmarks.relative(spark.createDataFrame([(day(0), 0.1, 0.0), (day(1), 0.0, 0.05)], "d date, r double, b double")).first()
    assert r.top == day(0) and math.isclose(r.relative, 1.1 / 1.05 - 1) and r.cagr_without == 0.0 and r.difference < 0
    c = {x.freq: x for x in benchmarks.correlations(spark.createDataFrame([(day(k), (k % 3) / 10, (k % 3) / 5 - 0.1) for k in range(60)], "d date, r double, b double")).collect()}
    assert set(c) == {"D", "W", "M", "Q"} and c["D"].n == 60 and math.isclose(c["D"].pearson, 1.0) and math.isclose(c["D"].spearman, 1.0) and c["Q"].n == 1


def test_regimes(spark):
    df = spark.createDataFrame([(day(3), "b"), (day(0), "z"), (day(1), "a"), (day(1), "b"), (day(2), None)], "d date, s string")
    assert {r.s: r.regime for r in regimes.by_source(df, "s", "d").collect()} == {"z": 0, "a": 1, "b": 2, None: 3} and regimes.by_source(df, "s", "d").count() == 5
    cut = df.select("d", regimes.by_cuts(F.col("d"), ["2024-01-02", "2024-01-04"]).alias("k"))
    assert sorted((r.d.day, r.k) for r in cut.collect()) == [(1, 0), (2, 1), (2, 1), (3, 1), (4, 2)]
    with pytest.raises(ValueError):
        regimes.by_cuts(F.col("d"), ["2024-01-04", "2024-01-02"])
    years = spark.createDataFrame([(dt.date(y, 1, k), k <= n) for y, n in ((2020, 1), (2021, 2), (2022, 7), (2023, 8)) for k in range(1, 11)], "d date, f boolean")
    of = lambda least: {r.d.year: r.regime for r in regimes.by_step(years, "d", F.col("f"), least).collect()}
    assert of(0.3) == {2020: 0, 2021: 0, 2022: 1, 2023: 1} and set(of(0.9).values()) == {0} and [round(r.step, 2) for r in regimes.yearly_shares(years, "d", F.col("f")).orderBy("y").collect()[1:]] == [0.1, 0.5, 0.1]


def test_regimes_by_step_agree_with_sql_on_odd_tables(spark, tmp_path):
    def at(name, rows):
        (tmp_path / name).mkdir()
        for table, columns, of in (("orders", ("o_orderdate", "o_totalprice"), rows), ("lineitem", ("l_shipdate", "l_extendedprice"), [])):
            parquet.write_table(pa.table({c: pa.array([r[k] for r in of], t) for k, (c, t) in enumerate(zip(columns, (pa.date32(), pa.float64()), strict=True))}), tmp_path / name / f"{table}.parquet")
        return str(tmp_path / name)

    cases = {
        "level": [(dt.date(y, 1, k), 200_000.0) for y in (2020, 2021) for k in (1, 2)], "one_year": [(dt.date(2020, 1, 1), 1.0)], "none": [],
        "no_price": [(dt.date(2020, 1, 1), 200_000.0), (dt.date(2020, 1, 2), None), (dt.date(2021, 1, 1), 200_000.0), (dt.date(2022, 1, 1), 1.0)],
        "no_day": [(None, 1.0), (dt.date(2020, 1, 1), 200_000.0), (dt.date(2021, 1, 1), 200_000.0), (dt.date(2021, 1, 2), 1.0)],
    }
    for name, rows in cases.items():
        sf = at(name, rows)
        same(catalogue.queries()["regimes_by_step"](spark, sf), catalogue.oracle_sql()["regimes_by_step"], sf)
    assert catalogue.queries()["regimes_by_step"](spark, str(tmp_path / "level")).count() == 0


def test_a_csv_without_rows_has_its_header(spark, tmp_path):
    tables.write_table(spark.createDataFrame([], "k int, x double"), f"{tmp_path}/none.csv")
    assert [p.read_text().strip() for p in (tmp_path / "none.csv").glob("part-*")] == ["k,x"]
    df = spark.createDataFrame([("spy ",), ("QQQ",), (None,)], "symbol string")
    assert tuple(tables.symbol_counts(df, "SPY").first()) == (1, 2)
