"""Duplicates of keys: which conflict, and what a policy makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("error", "source", "last", "identical")


def conflicts(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, n, variants) of keys whose rows differ in `values`; null is a value."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*values)).alias("variants")).where("variants > 1")


def resolved(df: DataFrame, key: str, values: list[str], policy: str, order: str, source: str | None = None, precedence: list | None = None) -> DataFrame:
    """One row a key. error: a key of several rows is one; identical: rows that agree are one, a key whose rows differ is an error; source: the row of the first source in
    `precedence`, then the last; last: the last by `order`. One row a key and task is shuffled, no group is sorted."""
    if policy not in POLICIES:
        raise ValueError(f"policy {policy} isn't one of {POLICIES}")
    if policy == "error" and not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats")
    if policy == "identical" and not conflicts(df, key, values).isEmpty():
        raise ValueError(f"rows of one {key} differ")
    rank = F.lit(0)
    if policy == "source":
        known = [r[0] for r in df.select(source).distinct().limit(len(precedence) + 1).collect()]
        if set(known) - set(precedence):
            raise ValueError(f"sources without a precedence: {set(known) - set(precedence)}")
        rank = -F.array_position(F.array(*[F.lit(s) for s in precedence]), F.col(source))
    best = F.max_by(F.struct(*df.columns), F.struct(rank.cast("long"), F.col(order)))
    return df.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def dividends(df: DataFrame, policy: str = "error") -> DataFrame:
    """(d, amount, n) of (d, amount): rows repeated exactly count once; a date with several amounts is an error, or their sum, or the least of them (`first`)."""
    once = df.where("d is not null and amount is not null").dropDuplicates(["d", "amount"])
    if policy == "error" and not once.groupBy("d").count().where("count > 1").isEmpty():
        raise ValueError("dates with several amounts")
    return once.groupBy("d").agg((F.sum("amount") if policy == "sum" else F.min("amount")).alias("amount"), F.count("*").alias("n"))
