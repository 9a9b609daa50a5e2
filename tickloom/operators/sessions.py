"""Sessions of a calendar: ticks attached to them, scheduled against observed minutes, halts, grades and tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.times import in_session, minute_of


def attached(ticks: DataFrame, schedule: DataFrame, label: str = "start", at: str = "ts") -> DataFrame:
    """ticks with d, opens, closes of the latest session that opened at or before them, inside and m, the minute of the session.

    schedule has sessions (d, opens, closes), several a day if need be. Each day gets its own, in order, and the last one before it; ticks are joined to their day, so neither side is sorted by time.
    """
    bounds = ticks.agg(F.min(F.to_date(at)).alias("a"), F.max(F.to_date(at)).alias("z")).where("a is not null")
    days = bounds.select(F.explode(F.sequence("a", "z")).alias("day")).unionByName(schedule.select(F.to_date("opens").alias("day"))).distinct()
    opened = schedule.groupBy(F.to_date("opens").alias("day")).agg(F.array_sort(F.collect_list(F.struct("opens", "d", "closes"))).alias("own"))
    own = days.join(opened, "day", "left")
    before = F.last(F.get("own", F.size("own") - 1), ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    joined = ticks.withColumn("_day", F.to_date(at)).join(own.withColumn("before", before), F.col("_day") == F.col("day"), "left").withColumn("_at", F.col(at))
    begun = F.expr("filter(own, s -> s.opens <= _at)")
    of = F.when(F.size(begun) > 0, F.get(begun, F.size(begun) - 1)).otherwise(F.col("before"))
    out = joined.withColumn("_of", of).select(*ticks.columns, "_of.d", "_of.opens", "_of.closes")
    return out.withColumn("inside", in_session(F.col(at), F.col("opens"), F.col("closes"), label)).withColumn("m", minute_of(F.col(at), F.col("opens"), label))


def halt_minutes(schedule: DataFrame, halts: DataFrame, label: str = "start") -> DataFrame:
    """(d, m) of each halted minute: windows (d, starts, ends) of a schedule (d, opens, bars), minutes cut off, clamped to the session, each once."""
    offset = 1 if label == "start" else 0
    minutes = lambda c: F.floor((F.unix_timestamp(c) - F.unix_timestamp("opens")) / 60).cast("int") + offset
    found = halts.where("ends >= starts").join(schedule.select("d", "opens", "bars"), "d")
    return found.select("d", "bars", F.explode(F.sequence(minutes("starts"), minutes("ends"))).alias("m")).where((F.col("m") >= 1) & (F.col("m") <= F.col("bars"))).select("d", "m").distinct()


def diagnostics(bars: DataFrame, schedule: DataFrame, halts: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """A row a session of schedule (d, bars): counts of scheduled, halted, required, observed, missing, present and unexpected minutes, where the missing are, the first and last
    observed, volume, rows that aren't valid, whether open and close are. Scheduled and observed minutes (d, m, volume) meet in a full outer join."""
    slots = schedule.select("d", F.explode(F.sequence(F.lit(1), F.col("bars"))).alias("m")).join(halts.withColumn("halt", F.lit(True)), ["d", "m"], "left").withColumn("scheduled", F.lit(True))
    g = slots.join(bars.groupBy("d", "m").agg(F.sum("volume").alias("volume")).withColumn("observed", F.lit(True)), ["d", "m"], "full")
    g = g.select("d", "m", "volume", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("scheduled", "observed", "halt")])
    need = F.col("scheduled") & ~F.col("halt")
    gone = need & ~F.col("observed")
    w = Window.partitionBy("d")
    seen = F.when(F.col("observed"), F.col("m"))
    g = g.withColumn("first_m", F.min(seen).over(w)).withColumn("last_m", F.max(seen).over(w))
    leads = gone & (F.col("first_m").isNull() | (F.col("m") < F.col("first_m")))
    trails = gone & ~leads & (F.col("m") > F.col("last_m"))
    counts = g.groupBy("d").agg(
        F.count_if("scheduled").alias("scheduled"), F.count_if(F.col("scheduled") & F.col("halt")).alias("halted"), F.count_if(need).alias("required"), F.count_if("observed").alias("observed"),
        F.count_if(gone).alias("missing"), F.count_if(F.col("halt") & F.col("observed")).alias("present_in_halt"), F.count_if(~F.col("scheduled") & F.col("observed")).alias("unexpected"),
        F.count_if(leads).alias("leading"), F.count_if(gone & ~leads & ~trails).alias("interior"), F.count_if(trails).alias("trailing"),
        F.min(seen).alias("first_m"), F.max(seen).alias("last_m"), F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"),
    )
    out = schedule.select("d").join(counts, "d", "left")
    bad = invalid.select("d", F.col("n").alias("invalid")) if invalid is not None else None
    out = out.join(bad, "d", "left").withColumn("invalid", F.coalesce("invalid", F.lit(0))) if bad is not None else out.withColumn("invalid", F.lit(0))
    return out.withColumn("open_valid", (F.col("leading") == 0) & (F.col("observed") > 0)).withColumn("close_valid", (F.col("trailing") == 0) & (F.col("observed") > 0))


def graded(diagnosed: DataFrame, halted_bars: str = "absent", sparse: float = 0.5) -> DataFrame:
    """Adds quality and the tiers paper_ready, halt_usable and exploratory. halted_bars: whether bars in a halt are an anomaly (absent) or not."""
    absent = F.lit(halted_bars == "absent")
    clean = (F.col("missing") == 0) & (F.col("invalid") == 0)
    quality = (
        F.when(F.col("observed") == 0, "absent").when(F.col("unexpected") > 0, "halt_anomaly").when((F.col("halted") > 0) & (F.col("present_in_halt") > 0) & absent, "halt_anomaly")
        .when(clean & (F.col("halted") > 0), "halt_adjusted").when(clean, "complete").when(F.col("observed") < sparse * F.col("required"), "sparse")
        .when(F.col("leading") + F.col("trailing") >= F.col("interior"), "truncated").otherwise("interior_gap")
    )
    out = diagnosed.withColumn("quality", quality).withColumn("paper_ready", (quality == "complete") & (F.col("invalid") == 0))
    usable = quality.isin("complete", "halt_adjusted") & ((F.col("present_in_halt") == 0) | ~absent) & (F.col("invalid") == 0)
    return out.withColumn("halt_usable", usable).withColumn("exploratory", ~quality.isin("absent", "sparse", "halt_anomaly"))


def longest_run(df: DataFrame, flag: str, order: str) -> DataFrame:
    """(longest): rows of the longest run, by `order`, in which `flag` holds. One row a session: bounded by days."""
    w = Window.orderBy(order)
    runs = df.select(flag, (F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w)).alias("_run"))
    return runs.where(flag).groupBy("_run").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("longest"))
