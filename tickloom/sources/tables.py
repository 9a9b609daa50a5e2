"""Tables from files: by suffix, by columns and by cell; written by suffix. Names and types of raw bars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARQUET, CSV = ("parquet", "pq"), ("csv", "txt")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A table by the suffix of its path: parquet and pq, or csv and txt with a header; anything else is an error. Only `columns` are read."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in PARQUET:
        df = spark.read.parquet(path)
    elif suffix in CSV:
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader).csv(path)
    else:
        raise ValueError(f"no reader for .{suffix}: {path}")
    return df.select(*columns) if columns else df


def of_cell(df: DataFrame, cell_id, column: str = "cell_id") -> DataFrame:
    """The rows of one cell: the filter reaches the Parquet scan, or prunes partitions where the table is partitioned by it."""
    return df.where(F.col(column) == cell_id)


def write_table(df: DataFrame, path: str) -> None:
    """Writes by suffix; a CSV has floats with 12 significant digits and a header even without rows."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in PARQUET:
        df.write.option("compression", "zstd").parquet(path)
    elif suffix in CSV:
        text = [F.format_string("%.12g", F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema]
        df.select(*[F.when(F.col(f.name).isNotNull(), c).alias(f.name) for f, c in zip(df.schema, text, strict=True)]).write.option("header", True).csv(path)
    else:
        raise ValueError(f"no writer for .{suffix}: {path}")


def plain_names(names: list[str]) -> list[str]:
    """Lower case, runs of other characters than letters and digits as one underscore, none at the ends."""
    return [re.sub("[^a-z0-9]+", "_", n.lower()).strip("_") for n in names]


def resolved(df: DataFrame, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    """Columns by their canonical names: of each name's aliases the first that df has. A required one that is missing is an error."""
    plain = dict(zip(plain_names(df.columns), df.columns, strict=True))
    found = {canon: next((plain[a] for a in [canon, *names] if a in plain), None) for canon, names in aliases.items()}
    missing = [c for c in required if found.get(c) is None]
    if missing:
        raise ValueError(f"columns missing: {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{src}`").alias(canon) for canon, src in found.items() if src is not None])


def fullest(df: DataFrame, candidates: list[str], forced: str | None = None) -> str:
    """The candidate column with the largest share of values, the first of equals; `forced` if given."""
    if forced is not None:
        if forced not in df.columns:
            raise ValueError(f"no column {forced}")
        return forced
    here = [c for c in candidates if c in df.columns]
    if not here:
        raise ValueError(f"none of {candidates}")
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in here]).first()
    return max(here, key=lambda c: shares[c] or 0.0)


def of_symbol(df: DataFrame, symbol: str, column: str = "symbol") -> DataFrame:
    """The rows of a symbol whatever its case; none is an error."""
    rows = df.where(F.upper(F.trim(F.col(column))) == symbol.upper())
    if rows.isEmpty():
        raise ValueError(f"no rows of {symbol}")
    return rows


def numeric(c: str) -> Column:
    """A number, or null for what isn't one."""
    return F.expr(f"try_cast(`{c}` as double)")


def symbol_counts(df: DataFrame, symbol: str, column: str = "symbol") -> DataFrame:
    """(kept, dropped): rows that of_symbol() keeps, and those of other symbols or none."""
    here = F.coalesce(F.upper(F.trim(F.col(column))) == symbol.upper(), F.lit(False))
    return df.agg(F.count_if(here).alias("kept"), F.count_if(~here).alias("dropped"))
