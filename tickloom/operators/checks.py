"""Checks that ride in a plan: a bad row stops the job that meets it, and what is counted is counted while rows go by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def guarded(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, of which a row that breaks a rule (that isn't true of it) stops the job with the rule's name. No second scan."""
    broken = F.lit(None).cast("string")
    for name, ok in rules.items():
        broken = F.coalesce(broken, F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))
    return df.where(F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("broken rule: "), broken)).cast("boolean")).otherwise(F.lit(True)))


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, whose job stops if keys repeat: rows of a key stand beside each other and each looks at the one before, so a key of many rows is stopped at its second."""
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) > 1
    return guarded(df.withColumn("_again", again), {f"{', '.join(keys)} once": ~F.col("_again")}).drop("_again")


def counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """(df, observation): metrics are aggregates of the rows that the job writes; observation.get has them afterwards."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


def index_faults(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(side, n): keys that a alone or b alone has, and those that come more than once in either. No row: the same index."""
    one = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = one(a, "n_a").alias("a").join(one(b, "n_b").alias("b"), on, "full")
    tally = both.agg(F.count_if(F.col("n_b").isNull()).alias("first"), F.count_if(F.col("n_a").isNull()).alias("second"), F.count_if((F.col("n_a") > 1) | (F.col("n_b") > 1)).alias("repeated"))
    return tally.unpivot([], tally.columns, "side", "n").where("n > 0")


def same_index(a: DataFrame, b: DataFrame, *keys: str) -> None:
    """An error if keys of a and b aren't the same, each once."""
    found = {r.side: r.n for r in index_faults(a, b, *keys).collect()}
    if found:
        raise ValueError(f"{', '.join(keys)} differ: {found}")


def incomplete(df: DataFrame, expected: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of combinations of `expected` that df has not exactly once, and of those that df has beyond it."""
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    have = df.groupBy(*keys).agg(F.count("*").alias("n"))
    both = expected.select(*keys).distinct().withColumn("_due", F.lit(True)).alias("e").join(have.alias("g"), on, "full")
    return both.where(F.col("_due").isNull() | F.coalesce(F.col("n") != 1, F.lit(True))).select(*[F.coalesce(F.col(f"e.{k}"), F.col(f"g.{k}")).alias(k) for k in keys], F.coalesce("n", F.lit(0)).alias("n"), F.col("_due").isNotNull().alias("due"))


def parity(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """(column, n, unlike, most): over keys that both have, how many pairs there are, in how many one side alone is null, and the largest absolute difference."""
    pairs = a.select(*on, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(*on, *[F.col(c).alias(f"b_{c}") for c in columns]), on)
    gaps = F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("gap"), (F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull()).alias("unlike")) for c in columns])
    return pairs.select(F.explode(gaps).alias("x")).groupBy("x.column").agg(F.count("*").alias("n"), F.count_if("x.unlike").alias("unlike"), F.max("x.gap").alias("most"))


def audited_series(df: DataFrame, key: str, required: list[str], periods: dict[str, Column]) -> DataFrame:
    """df with a column `period`, guarded: required values are there, a key comes once, and each row is in one period. A column that isn't there is an error at once."""
    missing = [c for c in (key, *required) if c not in df.columns]
    if missing:
        raise ValueError(f"series without {missing}")
    inside = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in periods.items()]))
    rows = guarded(df.withColumn("_in", inside), {**{f"{c} is there": F.col(c).isNotNull() & ~F.col(c).cast("string").eqNullSafe("NaN") for c in required}, "one period": F.size("_in") == 1})
    return unique(rows, key).withColumn("period", F.col("_in")[0]).drop("_in")
