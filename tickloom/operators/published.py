"""Published figures against recomputed ones: wide tables made long, full outer comparison with reasons, errors by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.checks import unique

#: Columns of a table of monthly figures, in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def long_months(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(monthly, yearly) of a table year, jan to dec, yearly: monthly (year, month, published) without the months that are null, yearly (year, last_month, published). A missing column is an error, a repeated year stops the job."""
    missing = [c for c in ("year", *MONTHS, "yearly") if c not in wide.columns]
    if missing:
        raise ValueError(f"table without {missing}")
    once = unique(wide.select(F.col("year").cast("int").alias("year"), *[F.col(c).cast("double").alias(c) for c in (*MONTHS, "yearly")]), "year")
    months = once.unpivot("year", list(MONTHS), "name", "published").where("published is not null")
    months = months.select("year", F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.col("name")).cast("int").alias("month"), "published")
    last = F.greatest(*[F.when(F.col(c).isNotNull(), k) for k, c in enumerate(MONTHS, 1)])
    return months, once.select("year", last.alias("last_month"), F.col("yearly").alias("published"))


def compared(published: DataFrame, actual: DataFrame, on: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, on, published, actual, difference, absolute, available, comparable, reason) of published (on, published) and actual (by, on, actual, sessions, due), in a full outer join.

    reason is not_published, no_sessions (nothing to compare with), no_returns (no figure), incomplete (fewer sessions than due), or empty where both can be compared. Each group of `by` meets all that is published.
    """
    want = published
    if by:
        # Groups are variants of one result: a short dimension, each of which is held against every published figure.
        want = published.crossJoin(F.broadcast(actual.select(*by).distinct()))
    both = want.withColumn("_p", F.lit(True)).join(actual.withColumn("_a", F.lit(True)), [*by, *on], "full")
    lost = F.col("actual").isNull() | F.isnan("actual")
    reason = F.when(F.col("_p").isNull(), "not_published").when(F.col("_a").isNull(), "no_sessions").when(lost, "no_returns").when(F.col("sessions") < F.col("due"), "incomplete").otherwise("")
    gap = F.when(~lost, F.col("actual") - F.col("published"))
    available = F.col("_p").isNotNull() & F.col("_a").isNotNull() & ~lost
    return both.select(*by, *on, "published", F.when(~lost, F.col("actual")).alias("actual"), gap.alias("difference"), F.abs(gap).alias("absolute"), available.alias("available"), (reason == "").alias("comparable"), reason.alias("reason"))


def errors(comparison: DataFrame, by: tuple[str, ...] = (), thresholds: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """One row a group: how many are available and comparable, mean, median and largest absolute error, and the share in per cent within each threshold, of both. Null where there is none."""
    x = F.col("absolute")
    of = {"available": F.when(F.col("available"), x), "comparable": F.when(F.col("comparable"), x)}
    out = [F.count(of["available"]).alias("available"), F.avg(of["available"]).alias("mae_available"), F.count(of["comparable"]).alias("comparable"), F.avg(of["comparable"]).alias("mae"), F.percentile(of["comparable"], 0.5).alias("median"), F.max(of["comparable"]).alias("most")]
    for t in thresholds:
        name = str(t).replace(".", "_")
        out += [(F.avg((c <= t).cast("int")) * 100).alias(f"{kind}_within_{name}") for kind, c in of.items()]
    return comparison.groupBy(*by).agg(*out)


def classed(comparison: DataFrame, small: float = 0.5, large: float = 1.0) -> DataFrame:
    """comparison with class: close up to `small`, near up to `large`, else far; none where there is nothing to compare."""
    x = F.col("absolute")
    return comparison.withColumn("class", F.when(~F.col("available"), "none").when(x <= small, "close").when(x <= large, "near").otherwise("far"))
