"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a folder of our own, but only on one machine: executors elsewhere wouldn't see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    at = path(df.sparkSession, name)
    df.write.options(**options).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Whether Spark deletes the files of a query's shuffles when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def freed(df: DataFrame, name: str, **options: str) -> DataFrame:
    """written(), and the shuffles that it took leave the disk at once, not when the driver's memory is next cleaned."""
    with _freeing(df.sparkSession):
        return written(df, name, **options)


def removed(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for table in tables:
        for at in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            to = table.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            to.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(to, True)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same `keys` that come before this one in `order`.

    Rows are dealt out by range of (keys, order), so a key with a third of all rows spans many
    tasks; only one number a range and key is summed across ranges. `order` must be unique in a key.
    """
    ranged = written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    sums = sums.toDF(*[f"_key{i}" for i in range(len(keys))], "_at", "_start")
    on = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(sums, on).select(*ranged.columns, "_start")
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_start", "_range")


#: Bits of a filter of keys: 1 MB, however many keys there are.
FILTER_BITS = 1 << 23


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def filter_of(entries: DataFrame, key: Column) -> DataFrame:
    """One row, one array: a bit for each key of `entries` at its place, 64 a number. Its size is fixed; the fuller it is, the more rows are shuffled in vain."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = entries.select(_place(key).alias("at")).groupBy(F.floor(F.col("at") / 64).cast("long").alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = entries.sparkSession.range(FILTER_BITS // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return written(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits")), "filter")


def maybe_in(key: Column, bits: DataFrame) -> Column:
    """False for keys that aren't among those of filter_of."""
    at = _place(key)
    return F.call_function("shiftright", F.get(bits.scalar(), F.floor(at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


#: A key is hot where it has more than one in HOT of all rows, so fewer than HOT keys are; rows of a hot key are dealt to SALTS tasks.
HOT, SALTS = 1_000, 64


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], sizes: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) for keys of which some hold much of `left`; right has each key once, or few rows of each.

    sizes (keys, n) tells how many rows of `left` each key has, at least for those that `right` has too. The fewer than HOT hot keys are sent to
    all tasks; their rows are dealt out by a hash of `by`, and their rows of `right` are repeated for each salt.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(sizes.where(F.col("n") * HOT > total).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    repeated = right.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return dealt.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")
