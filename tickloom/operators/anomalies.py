"""Bars that look wrong: returns by the minutes between them, runs of zero volume and of stale prices, and the reports of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.windows import carried

KINDS = ("halt_reopen", "continuous", "gap")


def islands(rows: DataFrame, masks: dict[str, Column], at: str = "m", within: tuple[str, ...] = ("d",)) -> DataFrame:
    """(within, mask, first, last, n): runs of consecutive `at` in which a mask holds, of several masks in one pass. A run ends where `within` changes, where `at` jumps and where the mask doesn't hold.

    Rows are repeated for each mask that holds, which few do; the row number within a mask falls behind `at` by the same amount all along a run.
    """
    held = F.array_compact(F.array(*[F.when(m, F.lit(name)) for name, m in masks.items()]))
    kept = rows.select(*within, at, F.explode(held).alias("mask")).distinct()
    w = Window.partitionBy(*within, "mask").orderBy(at)
    return kept.withColumn("_run", F.col(at) - F.row_number().over(w)).groupBy(*within, "mask", "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_run")


def reopens(halts: DataFrame) -> DataFrame:
    """(d, m): the minute after each block of halted minutes (d, m), whether blocks were one window or several that touch."""
    return islands(halts, {"halt": F.lit(True)}).select("d", (F.col("last") + 1).alias("m"))


def classified(bars: DataFrame, halts: DataFrame, executable: Column | None = None) -> DataFrame:
    """bars (d, m, close) with prior_m and prior_close, of the last executable bar before in the session, elapsed minutes, r and kind.

    kind is halt_reopen at the minute after a halt, else continuous one minute after the bar before, else gap; null with r where the bar isn't executable or is the first. By default a bar with a close is executable.
    """
    ok = F.col("close").isNotNull() if executable is None else executable
    w = Window.partitionBy("d").orderBy("m")
    g = bars.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    g = g.withColumn("prior_m", carried(F.when(F.col("_ok"), F.col("m")), w, -1)).withColumn("prior_close", carried(F.when(F.col("_ok"), F.col("close")), w, -1))
    g = g.join(reopens(halts).withColumn("_reopen", F.lit(True)), ["d", "m"], "left")
    here = F.col("_ok") & F.col("prior_close").isNotNull()
    elapsed = F.col("m") - F.col("prior_m")
    kind = F.when(~here, None).when(F.col("_reopen"), KINDS[0]).when(elapsed == 1, KINDS[1]).otherwise(KINDS[2])
    return g.select(*bars.columns, "prior_m", "prior_close", elapsed.alias("elapsed"), F.when(here, F.try_divide("close", "prior_close") - 1).alias("r"), kind.alias("kind"))


def stale() -> Column:
    return (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))


def bad_runs(bars: DataFrame) -> DataFrame:
    """Runs of bars without volume and of bars of one price."""
    return islands(bars, {"zero_volume": F.col("volume") == 0, "stale_bar": stale()})


def report(bars: DataFrame, halts: DataFrame, extreme: float, cap: int = 500) -> dict[str, DataFrame]:
    """The four dumps and their counts. extreme_continuous: returns beyond `extreme`, largest first; gap and halt_reopen: all returns of their kind; runs: the `cap` longest of each
    mask; counts (name, n): rows of each, those beyond `extreme`, runs and the longest."""
    returns, runs = classified(bars, halts), bad_runs(bars)
    beyond = F.abs("r") > extreme
    order = [F.abs("r").desc_nulls_last(), F.col("d"), F.col("m")]
    of = lambda kind: returns.where(F.col("kind") == kind)
    longest = None
    for mask in ("zero_volume", "stale_bar"):
        top = runs.where(F.col("mask") == mask).orderBy(F.desc("n"), "d", "first").limit(cap)
        longest = top if longest is None else longest.unionByName(top)
    tally = returns.agg(
        F.count_if((F.col("kind") == "continuous") & beyond).alias("extreme_continuous"), F.count_if(F.col("kind") == "gap").alias("gap"), F.count_if((F.col("kind") == "gap") & beyond).alias("extreme_gap"),
        F.count_if(F.col("kind") == "halt_reopen").alias("halt_reopen"), F.count_if((F.col("kind") == "halt_reopen") & beyond).alias("extreme_halt_reopen"),
    )
    tally = tally.unpivot([], tally.columns, "name", "n")
    lengths = runs.groupBy("mask").agg(F.count("*").alias("runs"), F.max("n").alias("longest_run")).unpivot(["mask"], ["runs", "longest_run"], "what", "n")
    counts = tally.unionByName(lengths.select(F.concat_ws("_", "mask", "what").alias("name"), "n"))
    return {"extreme_continuous": of("continuous").where(beyond).orderBy(*order), "gap": of("gap").orderBy(*order), "halt_reopen": of("halt_reopen").orderBy(*order), "runs": longest, "counts": counts}
