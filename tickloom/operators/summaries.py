"""Summaries of variants by period: costs by kind, leverage bands, identities that have to hold, statuses, tables of quintiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def costs(daily: DataFrame, by: tuple[str, ...], kinds: tuple[str, ...], notional: str = "notional") -> DataFrame:
    """(by, kind, cost, share, bps): costs by kind as long rows of one aggregation, each with its share of all of them and in basis points of notional. A null counts as 0; a ratio over 0 is null."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    all_of = reduce(lambda a, b: a + b, [s(c) for c in kinds])
    cells = F.array(*[F.struct(F.lit(c).alias("kind"), s(c).alias("cost"), F.try_divide(s(c), all_of).alias("share"), (F.try_divide(s(c), s(notional)) * 10_000).alias("bps")) for c in kinds])
    return daily.groupBy(*by).agg(cells.alias("_cells")).select(*by, F.inline("_cells"))


def band(value: Column, edges: tuple[float, ...]) -> Column:
    """How many of the rising edges lie at or below the value: 0 to their number; null without a value."""
    if list(edges) != sorted(set(edges)):
        raise ValueError(f"edges don't rise: {edges}")
    n = reduce(lambda a, b: a + b, [(value >= e).cast("int") for e in edges], F.lit(0))
    return F.when(value.isNotNull() & ~F.isnan(value), n)


def by_band(daily: DataFrame, by: tuple[str, ...], value: str, edges: tuple[float, ...]) -> DataFrame:
    """(by, band, sessions, net, mean_bp, hit, share): results by bands of a value, and each band's share of its group's net. Few rows are left when shares are made."""
    x = daily.withColumn("band", band(F.col(value), edges)).groupBy(*by, "band").agg(F.count("*").alias("sessions"), F.sum("net").alias("net"), (F.avg("ret") * 1e4).alias("mean_bp"), F.avg((F.col("ret") > 0).cast("int")).alias("hit"))
    return x.withColumn("share", F.try_divide(F.col("net"), F.sum("net").over(Window.partitionBy(*by))))


def identity(df: DataFrame, by: tuple[str, ...], total: str, parts: dict[str, int], tolerance: float) -> DataFrame:
    """(by, rows, off, unknown, most): how far `total` is from the signed sum of its parts; a row in which any of them is null is unknown."""
    gap = F.abs(F.col(total) - reduce(lambda a, b: a + b, [F.col(c) * k for c, k in parts.items()]))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(gap > tolerance).alias("off"), F.count_if(gap.isNull()).alias("unknown"), F.max(gap).alias("most"))


def statuses(df: DataFrame, by: tuple[str, ...], status: str, of: tuple[str, ...]) -> DataFrame:
    """(by, statuses): those of `of` that a group has, in order, by commas; empty if none."""
    have = F.array_sort(F.array_intersect(F.collect_set(F.when(F.col(status).isin(*of), F.col(status))), F.array(*[F.lit(s) for s in of])))
    return df.groupBy(*by).agg(F.array_join(have, ",").alias("statuses"))


def quintile_table(days: DataFrame, value: str, r: str, period: str, first: str, second: str, n: int = 5) -> DataFrame:
    """(quintile, columns of both periods, change): the n-tiles of a value, within each period, with sessions and mean returns beside each other. Days without a value are left out."""
    x = days.where(F.col(value).isNotNull() & F.col(period).isin(first, second))
    x = x.withColumn("quintile", F.ntile(n).over(Window.partitionBy(period).orderBy(value, "d")))
    of = lambda p: F.col(period) == p
    mean = lambda p: F.avg(F.when(of(p), F.col(r))) * 1e4
    cells = [c for p in (first, second) for c in (F.count_if(of(p)).alias(f"{p}_sessions"), mean(p).alias(f"{p}_bp"))]
    return x.groupBy("quintile").agg(*cells, (mean(second) - mean(first)).alias("change"))
