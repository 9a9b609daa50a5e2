"""Queries of what is wrong with bars and tables: classified returns, runs, coverage, releases, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators import anomalies, checks
from tickloom.operators import features as X
from tickloom.plans.catalogue import _HALTS_SQL, halted, pair, query, r8, returns
from tickloom.sources import publish
from tickloom.sources.bars import DAILY_SQL, HOLED_SQL, benchmark, calendar, daily, grid, holed, table

_KINDS = (
    HOLED_SQL
    + ", cal AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS n FROM (SELECT DISTINCT d FROM grid)), "
    + _HALTS_SQL
    + """, hb AS (SELECT d, m, m - row_number() OVER (PARTITION BY d ORDER BY m) AS run FROM h), re AS (SELECT d, (max(m) + 1)::INT AS m FROM hb GROUP BY d, run), x AS (SELECT b.*, h.m IS NULL AS ok FROM bars b LEFT JOIN h ON h.d = b.d AND h.m = b.m),
 c AS (SELECT *, last_value(CASE WHEN ok THEN close END IGNORE NULLS) OVER p AS pc, last_value(CASE WHEN ok THEN m END IGNORE NULLS) OVER p AS pm FROM x WINDOW p AS (PARTITION BY d ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 k AS (SELECT c.d, c.m, pm, close / pc - 1 AS r, CASE WHEN re.m IS NOT NULL THEN 'halt_reopen' WHEN c.m - pm = 1 THEN 'continuous' ELSE 'gap' END AS kind FROM c LEFT JOIN re ON re.d = c.d AND re.m = c.m WHERE ok AND pc IS NOT NULL),
 u AS (SELECT d, m, 'zero_volume' AS mask FROM bars WHERE volume = 0 UNION ALL SELECT d, m, 'stale_bar' FROM bars WHERE open = high AND high = low AND low = close),
 runs AS (SELECT d, mask, min(m) AS first, max(m) AS last, count(*) AS n FROM (SELECT *, m - row_number() OVER (PARTITION BY d, mask ORDER BY m) AS run FROM u) GROUP BY d, mask, run)"""
)


def _taped(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Bars with `halt`, whether their minute is halted, and the halted minutes."""
    h = halted(spark, sf)
    return holed(spark, sf).join(h.withColumn("halt", F.lit(True)), ["d", "m"], "left"), h


@query(_KINDS + " SELECT d, m, kind, pm AS prior_m, round(r, 8) AS r FROM k", " ")
def return_kinds(spark, sf):
    """Returns over elapsed minutes; the minute after each block of halts is a reopening."""
    b, h = _taped(spark, sf)
    return anomalies.classified(b, h, F.col("halt").isNull()).where("kind is not null").select("d", "m", "kind", "prior_m", r8("r").alias("r"))


@query(_KINDS + " SELECT d, m, round(r, 8) AS r FROM k WHERE kind = 'gap' AND abs(r) > 0.5", " ")
def extreme_gaps(spark, sf):
    b, h = _taped(spark, sf)
    out = anomalies.classified(b, h, F.col("halt").isNull())
    return out.where((F.col("kind") == "gap") & (F.abs("r") > 0.5)).select("d", "m", r8("r").alias("r"))


@query(_KINDS + " SELECT d, mask, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY n DESC, d, first) AS k FROM runs) WHERE k <= 500", " ")
def anomaly_runs(spark, sf):
    b, h = _taped(spark, sf)
    return anomalies.report(b, h, 0.5)["runs"].select("d", "mask", "first", "last", "n")


@query(_KINDS.replace("h.m IS NULL AS ok", "true AS ok") + """ SELECT 'extreme_continuous' AS name, count(*) AS n FROM k WHERE kind = 'continuous' AND abs(r) > 0.5 UNION ALL SELECT 'gap', count(*) FROM k WHERE kind = 'gap' UNION ALL SELECT 'extreme_gap', count(*) FROM k WHERE kind = 'gap' AND abs(r) > 0.5
 UNION ALL SELECT 'halt_reopen', count(*) FROM k WHERE kind = 'halt_reopen' UNION ALL SELECT 'extreme_halt_reopen', count(*) FROM k WHERE kind = 'halt_reopen' AND abs(r) > 0.5 UNION ALL SELECT mask || '_runs', count(*) FROM runs GROUP BY mask UNION ALL SELECT mask || '_longest_run', max(n) FROM runs GROUP BY mask""", " ")
def anomaly_counts(spark, sf):
    """Every bar with a close counts as executable here."""
    b, h = _taped(spark, sf)
    return anomalies.report(b, h, 0.5)["counts"]


_SCHEDULED = HOLED_SQL + ", s AS (SELECT g.*, min(m) FILTER (close IS NOT NULL) OVER (PARTITION BY d) AS a FROM grid g WHERE m <= 12 OR isodow(d) <> 5), v AS (SELECT d, m, close IS NOT NULL AND a = 1 AS usable FROM s WHERE m % 3 = 0)"


@query(_SCHEDULED + " SELECT d, m, coalesce(usable, false) AS usable, count(*) OVER w AS eligible, coalesce(sum(coalesce(usable, false)::INT) OVER w, 0)::BIGINT AS prior_usable, coalesce(sum(coalesce(usable, false)::INT) OVER w, 0) >= 5 AS warm FROM v WINDOW w AS (PARTITION BY m ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", " ")
def minute_coverage(spark, sf):
    """Fridays close at minute 12. A close is usable where its session had a bar at its open."""
    g = grid(spark, sf, holed).where((F.col("m") <= 12) | (F.dayofweek("d") != 6))
    g = g.withColumn("a", F.min(F.when(F.col("close").isNotNull(), F.col("m"))).over(Window.partitionBy("d")))
    return X.coverage(g, 5, F.col("close").isNotNull() & (F.col("a") == 1))


# Checks in the plan, and releases.


@query(" SELECT 'first' AS side, count(*) AS n FROM daily d WHERE NOT EXISTS (SELECT 1 FROM daily2 b WHERE b.d = d.d) HAVING n > 0 UNION ALL SELECT 'second', count(*) AS n FROM daily2 b WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE b.d = d.d) HAVING n > 0", DAILY_SQL)
def index_faults(spark, sf):
    return checks.index_faults(daily(spark, sf), benchmark(spark, sf), "d")


@query(" SELECT 'r' AS \"column\", count(*) AS n, 0::BIGINT AS unlike, round(max(abs(r - b)), 8) AS most FROM pair UNION ALL SELECT 'up', count(*), count(*) FILTER ((CASE WHEN r > 0 THEN r END IS NULL) <> (CASE WHEN b > 0 THEN b END IS NULL)), round(max(abs(r - b)) FILTER (r > 0 AND b > 0), 8) FROM pair", DAILY_SQL)
def baseline_parity(spark, sf):
    """The largest differences of two series by day, and of their gains, which one side often has alone."""
    p = pair(spark, sf)
    side = lambda c: p.select("d", F.col(c).alias("r"), F.when(F.col(c) > 0, F.col(c)).alias("up"))
    return checks.parity(side("r"), side("b"), ["d"], ["r", "up"]).withColumn("most", r8("most"))


@query("WITH m AS (SELECT DISTINCT user_id FROM events), e AS (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error'), due AS (SELECT * FROM m CROSS JOIN e), have AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT coalesce(due.user_id, have.user_id) AS user_id, coalesce(due.event_type, have.event_type) AS event_type, coalesce(n, 0) AS n, due.user_id IS NOT NULL AS due FROM due FULL JOIN have ON due.user_id = have.user_id AND due.event_type = have.event_type WHERE n IS DISTINCT FROM 1 OR due.user_id IS NULL")
def incomplete_matrix(spark, sf):
    """Users and kinds of events that don't meet exactly once; errors aren't due at all."""
    e = table(spark, sf, "events").select("user_id", "event_type")
    # Kinds are a handful: a dimension that is sent to all users.
    kinds = F.broadcast(e.where("event_type <> 'error'").select("event_type").distinct())
    return checks.incomplete(e, e.select("user_id").distinct().crossJoin(kinds), "user_id", "event_type")


@query(" SELECT CASE WHEN d < DATE '1998-01-01' THEN 'pre' ELSE 'post' END AS period, count(*) AS n, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM ret WHERE r IS NOT NULL GROUP BY 1", DAILY_SQL)
def audited_periods(spark, sf):
    """Ratios by period of a series whose keys, values and periods are checked as it is read."""
    from tickloom.functions import metrics

    x = checks.audited_series(returns(spark, sf).where("r is not null"), "d", ["r"], {"pre": F.col("d") < "1998-01-01", "post": F.col("d") >= "1998-01-01"})
    return x.groupBy("period").agg(F.count("*").alias("n"), r8(metrics.sharpe(F.col("r")), 6).alias("sharpe"))


_HASH = "count(*) AS rows, sum(('0x' || md5({0})[1:15])::HUGEINT)::VARCHAR AS hash FROM {1}"


@query(
    "SELECT 'nation' AS name, " + _HASH.format("concat_ws(chr(31), '=' || n_name, '=' || n_nationkey, '=' || n_regionkey)", "nation")
    + " UNION ALL SELECT 'labels', " + _HASH.format("concat_ws(chr(31), coalesce('=' || doc_id, '-'), coalesce('=' || quality, '-'), coalesce('=' || toxic, '-'))", "labels")
    + " UNION ALL SELECT 'customer', " + _HASH.format("concat_ws(chr(31), '=' || c_acctbal::DECIMAL(18,2), '=' || c_custkey, '=' || c_mktsegment, '=' || c_name, '=' || c_nationkey)", "customer")
)
def content_hashes(spark, sf):
    """Hashes of whole tables that two runs, or two engines, agree on whatever the order of rows."""
    c = table(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    of = lambda name, df: publish.content_hash(df).select(F.lit(name).alias("name"), "rows", "hash")
    return of("nation", table(spark, sf, "nation")).unionByName(of("labels", table(spark, sf, "labels"))).unionByName(of("customer", c))


@query(" SELECT 'closes' AS name, year(d)::INT AS y, count(*) AS n, round(sum(close::DECIMAL(18,2))::DOUBLE, 2) AS total FROM daily GROUP BY 2 UNION ALL SELECT 'benchmark', year(d)::INT, count(*), round(sum(close::DECIMAL(18,2))::DOUBLE, 2) FROM daily2 GROUP BY 2", DAILY_SQL)
def published_release(spark, sf):
    """Two series published as one release, held against its list of files, and read back."""
    root = publish.scratch(spark, "releases")
    publish.publish(spark, root, "r1", {"closes": daily(spark, sf), "benchmark": benchmark(spark, sf)}, {"of": sf}, {"sessions": calendar(spark, sf)})
    of = lambda name: publish.load(spark, root, name).groupBy(F.year("d").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("close").cast("decimal(18,2)")).cast("double"), 2).alias("total")).withColumn("name", F.lit(name))
    return of("closes").unionByName(of("benchmark"))
