"""Return metrics as aggregate columns. Missing is null; ratios with a zero below are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 365.2425
DAYS = 252


def years(d: Column) -> Column:
    """At least one day."""
    return F.greatest(F.datediff(F.max(d), F.min(d)), F.lit(1)) / F.lit(YEAR)


def total_return(r: Column) -> Column:
    return F.product(1 + r) - 1


def sharpe(r: Column, hurdle: float = 0.0) -> Column:
    """Mean excess over the standard deviation of raw returns, by year."""
    return F.try_divide(F.avg(r - F.lit(hurdle)), F.stddev_samp(r)) * F.sqrt(F.lit(float(DAYS)))


def skew(r: Column) -> Column:
    """Adjusted for bias; Spark's own is the population's."""
    n = F.count(r).cast("double")
    return F.when(n > 2, F.skewness(r) * F.sqrt(n * (n - 1)) / (n - 2))


def beta(r: Column, b: Column) -> Column:
    """The sample covariance over the population variance: the definition that published figures use."""
    return F.try_divide(F.covar_samp(r, b), F.var_pop(b))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's; null where one side doesn't vary."""
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(F.when(both, a)) * F.stddev_samp(F.when(both, b)))


def cagr(r: Column, years_: Column) -> Column:
    """Compounded growth a year; null where all is lost."""
    total = F.product(1 + r)
    return F.when(total > 0, F.pow(total, 1 / years_) - 1)


def cagr_of_count(r: Column, per_year: int = DAYS) -> Column:
    total = F.product(1 + r)
    return F.when(total > 0, F.pow(total, F.lit(float(per_year)) / F.count(r)) - 1)


def sortino(r: Column) -> Column:
    """Mean over the standard deviation of the losses, by year."""
    return F.try_divide(F.avg(r) * DAYS, F.stddev_samp(F.when(r < 0, r)) * F.sqrt(F.lit(float(DAYS))))


def hit_rate(r: Column) -> Column:
    """Share of gains among days that aren't 0."""
    return F.avg(F.when(r != 0, (r > 0).cast("int")))


def gains_ratio(part: Column, whole: Column) -> Column:
    """A ratio of sums, null over 0."""
    return F.try_divide(F.sum(part), F.sum(whole))
