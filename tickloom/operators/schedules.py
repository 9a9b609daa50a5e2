"""Effective-date schedules: what is wrong with one, and the rate of each fact's day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ("effective_from", "effective_to", "rate_per_million", "rate_decimal", "source_url", "notes")
#: What a schedule is held to, in the order in which it is reported.
RULES = ("rows", "start", "repeated_start", "open_end", "rate", "decimal", "reversed", "contiguous", "source")
#: Days of a bin. Facts and intervals meet by bins, so no fact is compared with intervals far from it.
WIDTH = 32


def typed(raw: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The schedule's columns with dates and numbers; what can't be read is null. A missing column is an error."""
    missing = [c for c in (*COLUMNS, *keys) if c not in raw.columns]
    if missing:
        raise ValueError(f"schedule without {missing}")
    day = lambda c: F.expr(f"try_cast(`{c}` as date)").alias(c)
    number = lambda c: F.expr(f"try_cast(`{c}` as double)").alias(c)
    return raw.select(*keys, day("effective_from"), day("effective_to"), number("rate_per_million"), number("rate_decimal"), "source_url", "notes")


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0)


def faults(schedule: DataFrame, prefix: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(rule, n, first): of each rule that rows of a typed schedule break, how many do and their first start. No row: the rule is kept.

    Rows follow each other within `keys` by start, those without a start left out; next starts come from one window, all rules from one pass.
    """
    w = Window.partitionBy(*keys, F.col("effective_from").isNull()).orderBy("effective_from", "effective_to")
    start, to = F.col("effective_from"), F.col("effective_to")
    rows = schedule.withColumn("_next", F.when(start.isNotNull(), F.lead("effective_from").over(w)))
    after, per, decimal = F.col("_next"), F.col("rate_per_million"), F.col("rate_decimal")
    broken = {
        "start": start.isNull(), "repeated_start": start == after, "open_end": to.isNull() & after.isNotNull(), "rate": _bad(per) | _bad(decimal),
        "decimal": F.abs(decimal - per / 1e6) > 1e-15, "reversed": to < start, "contiguous": after != F.date_add(to, 1),
        "source": ~F.coalesce(F.startswith("source_url", F.lit(prefix)), F.lit(False)),
    }
    names = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in broken.items()]))
    found = rows.select("effective_from", F.explode(names).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min("effective_from").alias("first"))
    none = schedule.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("rows").alias("rule"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("date").alias("first"))
    return found.unionByName(none)


def checked(raw: DataFrame, prefix: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The schedule, typed; an error that names the broken rules if there are any."""
    schedule = typed(raw, keys)
    found = {r.rule: (r.n, r.first) for r in faults(schedule, prefix, keys).collect()}
    if found:
        raise ValueError("schedule: " + ", ".join(f"{rule} ({found[rule][0]} rows, first {found[rule][1]})" for rule in RULES if rule in found))
    return schedule


def effective(facts: DataFrame, schedule: DataFrame, day: str, value: str = "rate_decimal", keys: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """facts with `value` of the interval that `day` is in; null where there is none.

    Closed intervals are put to bins of `width` days and meet the facts of their bin by an equi-join, whose strategy is chosen by the sizes that a run finds: small schedules
    are sent to the facts, large ones shuffled, and a bin with much of the facts is split. Open intervals, one a key at most, are joined by key alone. The schedule's
    intervals of a key mustn't overlap, which checked() makes sure of.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    bin_of = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / width)
    closed = schedule.where("effective_to is not null and effective_to >= effective_from")
    closed = closed.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("effective_from").alias("_a"), F.col("effective_to").alias("_z"), F.col(value).alias("_closed"), F.explode(F.sequence(bin_of("effective_from"), bin_of("effective_to"))).alias("_bin"))
    on = (F.floor(number / width) == F.col("_bin")) & F.col(day).between(F.col("_a"), F.col("_z"))
    open_ = schedule.where("effective_to is null and effective_from is not null").select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("effective_from").alias("_from"), F.col(value).alias("_open"))
    onward = F.col(day) >= F.col("_from")
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
        onward &= F.col(k) == F.col(f"_o_{k}")
    if not keys:
        # One row at most: with it, a join by range has one comparison a fact.
        open_ = F.broadcast(open_.orderBy(F.desc("_from")).limit(1))
    joined = facts.join(closed, on, "left").join(open_, onward, "left")
    return joined.select(*facts.columns, F.coalesce("_closed", "_open").alias(value))


def uncovered(facts: DataFrame, schedule: DataFrame, day: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, day, n): days of facts that no interval covers, and how many facts they have. Days are counted before they meet the schedule."""
    days = facts.groupBy(*keys, day).agg(F.count("*").alias("n"))
    return effective(days, schedule.withColumn("_here", F.lit(True)), day, "_here", keys).where("_here is null").drop("_here")


def covered(facts: DataFrame, schedule: DataFrame, day: str, value: str = "rate_decimal", keys: tuple[str, ...] = ()) -> DataFrame:
    """effective(), in which a fact without an interval stops the job; its message names the day. Facts aren't scanned twice."""
    out = effective(facts, schedule, day, value, keys)
    message = F.concat(F.lit("schedule misses "), F.coalesce(F.col(day).cast("string"), F.lit("a fact without a day")))
    return out.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(message).cast("double")).otherwise(F.col(value)))
