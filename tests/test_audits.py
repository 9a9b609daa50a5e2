"""Anomalies, checks in the plan and releases, by hand and in their failures."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickloom.operators import anomalies, checks
from tickloom.operators import features as X
from tickloom.sources import publish

DAY = dt.date(2023, 10, 16)


def bars(spark, rows, day=DAY):
    return spark.createDataFrame([(day, m, float(c), float(c), float(c), float(c), v) for m, c, v in rows], "d date, m int, open double, high double, low double, close double, volume long")


def test_returns_by_elapsed_minutes(spark):
    """Minutes 1, 2, 5, 6, 8 with a halt at 7: one extreme continuous return, one gap, one reopening."""
    b = bars(spark, [(1, 100, 9), (2, 102, 9), (5, 110, 9), (6, 111, 9), (8, 120, 9)])
    halts = spark.createDataFrame([(DAY, 7)], "d date, m int")
    out = anomalies.report(b, halts, 0.01)
    counts = {r.name: r.n for r in out["counts"].collect()}
    assert counts == {"extreme_continuous": 1, "gap": 1, "extreme_gap": 1, "halt_reopen": 1, "extreme_halt_reopen": 1, "stale_bar_runs": 3, "stale_bar_longest_run": 2}
    assert [(r.m, r.prior_m, r.elapsed, round(r.r, 6)) for r in out["gap"].collect()] == [(5, 2, 3, 0.078431)]
    assert [(r.m, r.prior_m, round(r.r, 6)) for r in out["halt_reopen"].collect()] == [(8, 6, 0.081081)]
    assert [r.m for r in out["extreme_continuous"].collect()] == [2]
    assert [(r["mask"], r["first"], r["last"], r.n) for r in anomalies.report(b, halts, 0.01, cap=1)["runs"].collect()] == [("stale_bar", 1, 2, 2)]
    kinds = {r.m: (r.kind, r.prior_m) for r in anomalies.classified(b, halts, F.col("m") != 2).collect()}
    assert kinds == {1: (None, None), 2: (None, 1), 5: ("gap", 1), 6: ("continuous", 5), 8: ("halt_reopen", 6)}
    empty = anomalies.report(b.limit(0), halts.limit(0), 0.01)
    assert empty["gap"].count() == 0 and {r.n for r in empty["counts"].collect()} == {0}


def test_islands_break_at_days_and_jumps(spark):
    two = bars(spark, [(22, 1, 0), (23, 1, 0), (24, 1, 5)]).unionByName(bars(spark, [(1, 1, 0), (3, 1, 0), (4, 1, 0), (4, 1, 0), (5, 1, None)], DAY + dt.timedelta(1)))
    got = sorted((r.d.day, r["first"], r["last"], r.n) for r in anomalies.islands(two, {"zero": F.col("volume") == 0}).collect())
    assert got == [(16, 22, 23, 2), (17, 1, 1, 1), (17, 3, 4, 2)]
    halts = spark.createDataFrame([(DAY, m) for m in (3, 4, 5, 9)] + [(DAY + dt.timedelta(1), 6)], "d date, m int")
    assert sorted((r.d.day, r.m) for r in anomalies.reopens(halts).collect()) == [(16, 6), (16, 10), (17, 7)]


def test_coverage_counts_sessions_that_scheduled_the_minute(spark):
    rows = [(dt.date(2024, 1, k), m, k != 2) for k in range(1, 6) for m in (3, 6, 7) if not (k == 3 and m == 6)]
    got = {(r.d.day, r.m): (r.eligible, r.prior_usable, r.warm) for r in X.coverage(spark.createDataFrame(rows, "d date, m int, ok boolean"), 2, F.col("ok")).collect()}
    assert got[5, 3] == (2, 2, True) and got[5, 6] == (2, 1, False) and got[1, 3] == (0, 0, False) and (5, 7) not in got and got[4, 3] == (2, 1, False)


def test_guards_stop_the_job(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (2, 3.0)], "k int, x double")
    with pytest.raises(PySparkException, match="broken rule: x is there"):
        checks.guarded(df, {"k": F.col("k") > 0, "x is there": F.col("x").isNotNull()}).collect()
    assert checks.guarded(df, {"k": F.col("k") > 0}).count() == 3
    with pytest.raises(PySparkException, match="k once"):
        checks.unique(df, "k").collect()
    assert checks.unique(df, "k", "x").count() == 3
    rows, seen = checks.counted(df, "three", rows=F.count(F.lit(1)), most=F.max("x"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "most": 3.0}


def test_index_and_parity(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "k int, x double")
    b = spark.createDataFrame([(1, 1.5), (3, None), (None, 3.0), (3, 1.0)], "k int, x double")
    assert {r.side: r.n for r in checks.index_faults(a, b, "k").collect()} == {"first": 1, "second": 1, "repeated": 1}
    checks.same_index(a, a, "k")
    with pytest.raises(ValueError, match="second"):
        checks.same_index(a, b, "k")
    assert [tuple(r) for r in checks.parity(a, b, ["k"], ["x"]).collect()] == [("x", 1, 0, 0.5)]
    assert sorted(tuple(r) for r in checks.incomplete(b.where("k is not null"), a.where("k is not null"), "k").collect()) == [(2, 0, True), (3, 2, False)]


def test_audited_series(spark):
    day = lambda n: dt.date(2024, 1, n)
    periods = {"pre": F.col("d") < "2024-01-03", "post": F.col("d") >= "2024-01-03"}
    good = spark.createDataFrame([(day(n), float(n)) for n in range(1, 5)], "d date, r double")
    assert {r.d.day: r.period for r in checks.audited_series(good, "d", ["r"], periods).collect()} == {1: "pre", 2: "pre", 3: "post", 4: "post"}
    for bad, p in ((good.unionByName(good.limit(1)), periods), (good.withColumn("r", F.when(F.col("r") > 1, F.col("r"))), periods), (good.withColumn("r", F.lit(float("nan"))), periods), (good, {"pre": periods["pre"]}), (good, {**periods, "all": F.lit(True)})):
        with pytest.raises(PySparkException, match="broken rule"):
            checks.audited_series(bad, "d", ["r"], p).collect()
    with pytest.raises(ValueError):
        checks.audited_series(good, "d", ["hurdle"], periods)


def test_content_hash(spark):
    df = spark.range(1_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("t"))
    same = publish.content_hash(df).first()
    assert publish.content_hash(df.repartition(7).orderBy(F.desc("id")).select("t", "id")).first() == same
    for other in (df.limit(999), df.unionByName(df.limit(1)), df.withColumn("t", F.coalesce("t", F.lit(""))), df.withColumn("id", F.when(F.col("id") != 5, F.col("id")).otherwise(6))):
        assert publish.content_hash(other).first() != same
    assert tuple(publish.content_hash(df.limit(0)).first()) == (0, "0")


def test_releases(spark, tmp_path):
    root = str(tmp_path / "releases")
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    at = publish.publish(spark, root, "r1", {"t": df.repartition(3), "none": df.limit(0)}, {"why": "test"}, {"audit": df.limit(5)})
    path, manifest = publish.released(spark, root)
    assert path == at and manifest["tables"]["t"]["rows"] == 100 and manifest["tables"]["t"]["files"] == 3 and manifest["tables"]["none"]["rows"] == 0 and manifest["meta"] == {"why": "test"}
    assert publish.load(spark, root, "t").count() == 100 and publish.damage(spark, at).count() == 0
    with pytest.raises(FileExistsError):
        publish.publish(spark, root, "r1", {"t": df})
    with pytest.raises(ValueError, match="no table"):
        publish.load(spark, root, "other")
    second = publish.publish(spark, root, "r2", {"t": df.orderBy(F.desc("id")).coalesce(1), "none": df.limit(0)})
    assert publish.differences(spark, at, second) == {}
    third = publish.publish(spark, root, "r3", {"t": df.withColumn("x", F.col("x") + 1)}, keep=2)
    assert set(publish.differences(spark, second, third)) == {"t", "none"} and not publish.exists(spark, at) and publish.exists(spark, second)
    assert publish.released(spark, root)[1]["release"] == "r3"
    one = next(p for p in (tmp_path / "releases/runs/r2/t").iterdir() if p.name.startswith("part-"))
    one.write_bytes(one.read_bytes()[:-1] + b"?")
    (tmp_path / "releases/runs/r2/t/.{}.crc".format(one.name)).unlink()
    assert [r.reason for r in publish.damage(spark, second).collect()] == ["sha256"]
    with pytest.raises(ValueError, match="isn't as it was published"):
        publish.load(spark, root, "t", "r2")
    publish.remove(spark, f"{second}/_SUCCESS")
    with pytest.raises(FileNotFoundError):
        publish.released(spark, root, "r2")


def test_a_failed_release_leaves_its_audits_alone(spark, tmp_path):
    root = str(tmp_path / "releases")
    bad = checks.guarded(spark.range(5), {"small": F.col("id") < 3})
    with pytest.raises(PySparkException, match="broken rule: small"):
        publish.publish(spark, root, "r1", {"fine": spark.range(3), "bad": bad}, audits={"repeats": spark.range(2)})
    left = sorted(p.name for p in (tmp_path / "releases").iterdir())
    assert left == ["failed"]
    failed = next((tmp_path / "releases/failed").iterdir())
    assert json.loads((failed / "failure.json").read_text())["audits"] == ["repeats"] and spark.read.option("header", True).csv(f"{failed}/repeats").count() == 2
    assert not publish.exists(spark, f"{root}/runs/r1")
