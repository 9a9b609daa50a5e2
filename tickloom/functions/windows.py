"""Window building blocks: gated rolling statistics, as-of carry, runs, running products."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def rolling(agg: Callable[[Column], Column], x: Column, w: WindowSpec, n: int, lag: int = 1, at_least: int | None = None) -> Column:
    """agg over the n rows that end `lag` rows before this one; null with fewer than `at_least` (default n) values in them."""
    frame = w.rowsBetween(-(n + lag - 1), -lag)
    return F.when(F.count(x).over(frame) >= (n if at_least is None else at_least), agg(x).over(frame))


def carried(x: Column, w: WindowSpec, until: int = 0) -> Column:
    """The last value that isn't null up to `until` rows from here."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, until))


def run_id(breaks: Column, w: WindowSpec) -> Column:
    """Numbers runs of rows: one more at each break."""
    return F.sum(F.coalesce(breaks.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def wealth(r: Column, w: WindowSpec) -> Column:
    """The running product of 1 + r; a null return counts as 0."""
    return F.product(1 + F.coalesce(r, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
