"""Series packed into binary: four-byte floats, least byte first, and flags as bits, first flag highest; and what they hold. In column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def float_hex(x: Column) -> Column:
    """Eight hex digits of x rounded to a four-byte float, least byte first. Null and NaN are a quiet NaN."""
    f = x.cast("float").cast("double")
    a = F.abs(f)
    # A four-byte float is a power of two times 1 to 2, exactly; the logarithm may be off by one next to a power.
    guess = F.floor(F.log2(a))
    power = F.greatest(F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess), F.lit(-126)).cast("double")
    whole = F.round(a * F.pow(F.lit(2.0), 23 - power)).cast("long")
    normal = ((power + 126) * (1 << 23)).cast("long") + whole
    bits = F.when(f.isNull() | F.isnan(f), F.lit(0x7FC00000)).when(a == float("inf"), F.lit(0x7F800000)).when(a == 0, F.lit(0)).otherwise(normal)
    # The sign of -0.0 can be seen in its text alone.
    sign = F.when(F.startswith(f.cast("string"), F.lit("-")), F.lit(1 << 31)).otherwise(F.lit(0))
    digits = F.lpad(F.hex(bits + sign), 8, "0")
    return F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)])


def hex_float(digits: Column) -> Column:
    """The number that float_hex() made digits of, as a double; a NaN is null."""
    bits = F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    body = bits.bitwiseAND(F.lit((1 << 31) - 1))
    power, part = F.floor(body / (1 << 23)), (body % (1 << 23)).cast("double")
    a = F.when(power == 255, F.when(part == 0, F.lit(float("inf")))).when(power == 0, part * F.pow(F.lit(2.0), F.lit(-149.0))).otherwise((1 + part / (1 << 23)) * F.pow(F.lit(2.0), power - 127.0))
    return F.when(bits >= 1 << 31, -a).otherwise(a)


def _bytes(bits: Column) -> Column:
    """Text of zeros and ones as bytes, filled up with zeros to whole ones."""
    size = F.ceil(F.length(bits) / 8).cast("int")
    filled = F.concat(bits, F.repeat(F.lit("0"), size * 8 - F.length(bits)))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.lpad(F.conv(F.substring(filled, k * 8 + 1, F.lit(8)), 2, 16), 2, "0")), ""))


def packed(df: DataFrame, by: tuple[str, ...], order: str, floats: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, each of floats and flags as binary) with the rows of a group by `order`, which is unique in it. A null flag is false. One group is one series: its rows are sorted in one task."""
    cells = [float_hex(F.col(c)).alias(c) for c in floats] + [F.when(F.col(c), "1").otherwise("0").alias(c) for c in flags]
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *cells))).alias("_rows"))
    out = [F.unhex(F.array_join(F.col(f"_rows.{c}"), "")).alias(c) for c in floats]
    out += [_bytes(F.array_join(F.col(f"_rows.{c}"), "")).alias(c) for c in flags]
    return rows.select(*by, F.size("_rows").alias("n"), *out)


def unpacked(df: DataFrame, by: tuple[str, ...], floats: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, values) of packed(): i counts rows of a group from 0."""
    rows = df.where("n > 0").select(*by, *[F.hex(c).alias(c) for c in (*floats, *flags)], F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    bit = lambda c: F.conv(F.substring(c, F.floor(F.col("i") / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    out = [hex_float(F.substring(c, F.col("i") * 8 + 1, F.lit(8))).alias(c) for c in floats]
    out += [(F.floor(bit(c) / F.pow(F.lit(2), 3 - F.col("i") % 4)) % 2 == 1).alias(c) for c in flags]
    return rows.select(*by, "i", *out)
