"""Figures of daily results, published tables, bootstraps, packing and made-up sessions against plain loops and by hand."""

import datetime as dt
import hashlib
import math
import statistics

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickloom.operators import inference, packing, performance, published
from tickloom.sources import synthetic

DAY = dt.date(2024, 1, 1)
ZERO = dict.fromkeys(("gross", "long_gross", "short_gross", "commission", "slippage", "cost", "cash_interest", "financing", "net", "shares", "notional"), 0.0) | dict.fromkeys(("signals", "fills", "units", "holding"), 0)


def results(spark, rows):
    rows = [ZERO | {"d": DAY + dt.timedelta(k), "status": "active", "hurdle": 0.0, "prev_aum": 100.0, "ret": 0.0} | r for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in sorted(rows[0])) for r in rows], ", ".join(f"{c} {'date' if c == 'd' else 'string' if c == 'status' else 'long' if isinstance(ZERO.get(c), int) else 'double'}" for c in sorted(rows[0])))


def test_performance_by_hand(spark):
    """Two sessions, one of them active: the edges a share and the ratios of an average of 100."""
    rows = [{"ret": 0.1, "gross": 12.0, "long_gross": 12.0, "cost": 2.0, "commission": 1.5, "slippage": 0.5, "net": 10.0, "shares": 40.0, "notional": 300.0, "signals": 3, "holding": 50}, {"ret": None, "status": "unknown_exit", "financing": -1.0, "net": -1.0, "signals": 1, "holding": 10}]
    r = performance.performance(results(spark, rows).withColumn("w", F.lit("all")), ("w",)).first()
    assert len(r) == 35 and (r.sessions, r.active, r.unknown_exits, r.signals) == (2, 1, 1, 4)
    assert math.isclose(r.total, 0.1) and r.mdd == 0.0 and r.hit == 1.0 and r.worst == 0.0
    assert (r.turnover, r.holding_per_active, r.gross_edge, r.cost_edge, r.financing_edge, r.after_costs_edge, r.net_edge) == (3.0, 60.0, 0.3, 0.05, 0.025, 0.225, 0.225)
    assert math.isclose(r.years, 1 / 365.2425) and math.isclose(r.sharpe, 0.05 / statistics.stdev([0.1, 0.0]) * math.sqrt(252))
    none = performance.performance(results(spark, [{}]).withColumn("w", F.lit("all")), ("w",)).first()
    assert none.gross_edge is None and none.sharpe is None and none.hit is None and none.cagr == 0.0


def test_linked_parts_add_up(spark):
    """0.10 and -0.03: contributions add up to 1.10 * 0.97 - 1."""
    rows = [{"ret": 0.10, "long_gross": 12.0, "commission": 1.0, "slippage": 2.0, "cash_interest": 1.0}, {"ret": -0.03, "short_gross": -2.0, "financing": -1.0}, {"ret": None, "status": "absent", "long_gross": 50.0}]
    daily = results(spark, rows)
    bench = daily.select("d", F.when(F.col("d") > "2024-01-01", 0.01).alias("b"))
    r = performance.attributed(daily, bench, F.lit("p")).first()
    parts = {c: r[f"of_{c}"] for c in performance.PARTS}
    assert math.isclose(sum(parts.values()), 1.10 * 0.97 - 1) and math.isclose(parts["commission"], -0.01 * 0.97) and parts["short_gross"] == -0.02
    assert math.isclose(r.strategy, 0.067) and math.isclose(r.trading_only, 1.09 * 0.97 - 1) and math.isclose(r.mdd, -0.03) and r.complete and math.isclose(r.benchmark, 0.0201)
    late = performance.attributed(daily.where("d > '2024-01-02'"), bench, F.lit("p")).first()
    assert not late.complete and performance.attributed(daily, bench.limit(0), F.lit("p")).first().benchmark is None


def test_windows_and_benchmark(spark):
    days = 40
    daily = results(spark, [{"ret": math.sin(k) / 50 if k % 7 else None} for k in range(days)])
    bench = spark.createDataFrame([(DAY + dt.timedelta(k), math.cos(k) / 40 if k else None) for k in range(days) if k % 5], "d date, b double").unionByName(spark.createDataFrame([(DAY, None)], "d date, b double"))
    windows = spark.createDataFrame([(f"{a}-{z}", DAY + dt.timedelta(a), DAY + dt.timedelta(z)) for a in range(0, 30, 3) for z in (a + 4, a + 20)] + [("empty", DAY + dt.timedelta(99), DAY + dt.timedelta(120)), ("back", DAY + dt.timedelta(9), DAY)], "w string, a date, z date")
    got = {r.w: r for r in performance.against_benchmark(daily, bench, windows).collect()}
    ret = {k: math.sin(k) / 50 if k % 7 else 0.0 for k in range(days)}
    b = {k: math.cos(k) / 40 for k in range(1, days) if k % 5}
    assert "empty" not in got and "back" not in got and got["0-4"].beta is None and len(got) == 20
    for a in range(3, 30, 3):
        for z in (a + 4, a + 20):
            ks = [k for k in range(a, min(z, days - 1) + 1) if k in b]
            cov = np.cov([ret[k] for k in ks], [b[k] for k in ks])[0, 1]
            r = got[f"{a}-{z}"]
            assert math.isclose(r.beta, cov / np.var([b[k] for k in ks])) and math.isclose(r.b_total, math.prod(1 + b[k] for k in ks) - 1)
            assert math.isclose(r.alpha, (np.mean([ret[k] for k in ks]) - r.beta * np.mean([b[k] for k in ks])) * 252, rel_tol=1e-9, abs_tol=1e-12)
    path = [(r.nav, r.b_nav) for r in performance.paths(daily, bench, windows).where("w = '3-7'").orderBy("d").collect()]
    assert np.allclose([p[0] for p in path], np.cumprod([1 + ret[k] for k in range(3, 8)])) and np.allclose([p[1] for p in path], np.cumprod([1 + b.get(k, 0.0) for k in range(3, 8)]))
    for width in (1, 1_000):
        assert performance.in_windows(daily, windows, width=width).count() == performance.in_windows(daily, windows).count()


def test_trips_and_entry_buckets(spark):
    rows = spark.createDataFrame([(m,) for m in (None, 0, 1, 120, 121, 270, 271)], "m int")
    assert [r[0] for r in rows.select(performance.entry_bucket(F.col("m"))).collect()] == [None, None, "open_1_120", "open_1_120", "midday_121_270", "midday_121_270", "close_271_plus"]
    trips = spark.createDataFrame([("l", 2.0, 10), ("l", -1.0, 20), ("s", 0.0, 5)], "side string, gross double, holding int")
    assert sorted(tuple(r) for r in performance.trip_stats(trips, ("side",)).collect()) == [("l", 2, 1.0, 0.5, 0.5, 15.0), ("s", 1, 0.0, 0.0, 0.0, 5.0)]


def test_deltas(spark):
    s = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("b", "y", 5.0)], "v string, w string, n double")
    assert {(r.v, r.w): r.d_n for r in performance.deltas(s, "v", "a", ("w",), ("n",)).collect()} == {("a", "x"): 0.0, ("b", "x"): 2.0, ("b", "y"): None}


def test_published_tables(spark):
    names = ", ".join(f"{m} double" for m in published.MONTHS)
    wide = spark.createDataFrame([(2020, 1.0, None, *[None] * 10, 1.0), (2021, *[float(k) for k in range(12)], 9.0)], f"year int, {names}, yearly double")
    months, years = published.long_months(wide)
    assert months.count() == 13 and {(r.year, r.last_month, r.published) for r in years.collect()} == {(2020, 1, 1.0), (2021, 12, 9.0)}
    with pytest.raises(ValueError, match="yearly"):
        published.long_months(wide.drop("yearly"))
    with pytest.raises(PySparkException, match="year once"):
        published.long_months(wide.unionByName(wide.limit(1)))[0].collect()
    actual = spark.createDataFrame([("v", 2020, 1, 1.4, 20, 20), ("v", 2021, 1, 2.0, 19, 20), ("v", 2021, 2, float("nan"), 20, 20), ("v", 2019, 5, 1.0, 20, 20), ("u", 2020, 1, 1.0, 20, 20)], "v string, year int, month int, actual double, sessions long, due long")
    c = published.classed(published.compared(months.where("year = 2020 or month <= 3"), actual, ("year", "month"), ("v",)))
    got = {(r.v, r.year, r.month): (r.reason, r["class"]) for r in c.collect()}
    assert got["v", 2020, 1] == ("", "close") and got["v", 2021, 1] == ("incomplete", "far") and got["v", 2021, 2] == ("no_returns", "none") and got["v", 2021, 3] == ("no_sessions", "none") and got["v", 2019, 5] == ("not_published", "none") and got["u", 2021, 1] == ("no_sessions", "none")
    e = {r.v: r for r in published.errors(c, ("v",)).collect()}
    assert (e["v"].available, e["v"].comparable, e["v"].comparable_within_0_5, e["v"].available_within_1_0, e["u"].mae) == (2, 1, 100.0, 50.0, 0.0) and math.isclose(e["v"].mae_available, 1.2)
    alone = published.compared(months.limit(0), actual, ("year", "month"))
    assert {r.reason for r in alone.collect()} == {"not_published"} and published.errors(alone).first().mae is None


def test_bootstrap_draws_against_a_loop(spark):
    rng = np.random.default_rng(1)
    r = {"pre": rng.normal(0, 0.01, 37), "post": rng.normal(0.001, 0.02, 23)}
    series = spark.createDataFrame([(p, DAY + dt.timedelta(k), float(x), 0.0001) for p in r for k, x in enumerate(r[p])], "period string, d date, r double, h double")
    got = {(x.method, x.block, x.period, x.rep): x.sharpe for x in inference.sharpe_draws(series, ("circular", "moving"), (1, 5, 50), 4, 9).collect()}
    assert len(got) == 48
    for (method, block, period, rep), sharpe in got.items():
        x, n, picked = r[period], len(r[period]), []
        for b in range(-(-n // block)):
            s = int(hashlib.md5(f"9|{method}|{block}|{period}|{rep}|{b}".encode()).hexdigest()[:12], 16) % (n if method == "circular" else max(n - block + 1, 1))
            picked += [x[(s + o) % n] for o in range(min(block, n - b * block))]
        assert math.isclose(sharpe, math.sqrt(252) * (np.mean(picked) - 0.0001) / np.std(picked, ddof=1), rel_tol=1e-8)
    with pytest.raises(ValueError):
        inference.sharpe_draws(series, ("other",), (1,), 1)


def test_paired_record(spark):
    draws = spark.createDataFrame([("m", 1, p, k, x) for p, xs in (("pre", [1.0, 2.0, 3.0, 6.0]), ("post", [0.0, 3.0, 1.0, 0.0])) for k, x in enumerate(xs)], "method string, block int, period string, rep long, sharpe double")
    points = spark.createDataFrame([("pre", 2.5), ("post", 1.0)], "period string, point double")
    rows = {(r.period, r.level): r for r in inference.grid_record(draws, points, "pre", "post", (0.5, 0.9)).collect()}
    gap = rows["pre_minus_post", 0.5]
    # Differences are 1, -1, 2, 6; less the point of 1.5 they are -0.5, -2.5, 0.5, 4.5.
    assert (gap.point, gap.median, gap.one_sided, gap.two_sided) == (1.5, 1.5, 0.25, 0.5) and gap.low == 0.5 and gap.high == 3.0
    assert rows["pre", 0.9].one_sided is None and len(rows) == 6


@pytest.mark.parametrize("n", [1, 7, 8, 9, 40])
def test_packing_against_numpy(spark, n):
    edge = [0.0, -0.0, 1.0, -1.5, 2.0**-126, 2.0**-149, 1e-45, 3.4e38, 0.1, 1 / 3, -2.0**100, 1 - 2.0**-24, 1 + 2.0**-24, 2 - 2.0**-23, 5e-40, float("inf"), -float("inf"), None, float("nan"), 16777217.0]
    xs = [(edge * 2)[k] for k in range(n)]
    flags = [[True, False, None, True, True][k % 5] for k in range(n)]
    df = spark.createDataFrame([(k, x, f) for k, (x, f) in enumerate(zip(xs, flags, strict=True))], "k int, x double, f boolean").repartition(3).withColumn("g", F.lit("a"))
    row = packing.packed(df, ("g",), "k", ("x",), ("f",)).first()
    floats = np.array([np.nan if x is None else x for x in xs], "<f4")
    assert bytes(row.x) == floats.tobytes() and bytes(row.f) == np.packbits([bool(f) for f in flags]).tobytes() and row.n == n
    back = packing.unpacked(packing.packed(df, ("g",), "k", ("x",), ("f",)), ("g",), ("x",), ("f",)).orderBy("i").collect()
    assert [r.f for r in back] == [bool(f) for f in flags]
    assert all((r.x is None and np.isnan(y)) or r.x == float(y) for r, y in zip(back, floats, strict=True))


def test_synthetic_sessions(spark):
    schedule = spark.createDataFrame([(DAY + dt.timedelta(k), n) for k, n in enumerate((5, 0, 3, 4))], "d date, bars int")
    rows = synthetic.sessions(schedule, seed=3).orderBy("d", "m").collect()
    assert len(rows) == 12 and rows == synthetic.sessions(schedule.repartition(4), seed=3).orderBy("d", "m").collect()
    u = lambda d, m, k: (int(hashlib.md5(f"3|{d}|{m}|{k}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
    at = 0.0
    for r in rows:
        at += math.sqrt(-2 * math.log(u(r.d, r.m, "u"))) * math.cos(2 * math.pi * u(r.d, r.m, "v")) * synthetic.STEP
        assert math.isclose(r.open, 400 * math.exp(at), rel_tol=1e-12)
    line = synthetic.sessions(schedule, "linear").orderBy("d", "m").collect()
    assert [round(r.open, 2) for r in line[4:7]] == [400.05, 402.01, 402.02]
    with pytest.raises(ValueError):
        synthetic.sessions(schedule, "other")
