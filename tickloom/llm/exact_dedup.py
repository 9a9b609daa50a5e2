"""Exact dedup with a log-structured merge index of digests, in DataFrame operations only.

Documents are dealt to memtables; each is flushed as a run sorted by digest, with Parquet's Bloom filters. Compaction merges runs by FANOUT a level, keeping
the smallest id of each digest, until one is left. The filter of that run's repeated digests, of a fixed size, tells in the scan which documents
are hits at most: only their texts are shuffled and compared, byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import shared

#: Memtables that documents are dealt to by a hash of their id, and runs that a compaction merges to one.
MEMTABLES, FANOUT = 4, 4

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _flush(entries: DataFrame, at: str) -> DataFrame:
    """Writes runs sorted by digest, with Parquet's Bloom filters on it."""
    out = entries.sortWithinPartitions("run", "digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    out.partitionBy("run").parquet(at)
    return entries.sparkSession.read.schema(entries.schema).parquet(at)


def build_index(rows: DataFrame, memtables: int = MEMTABLES) -> DataFrame:
    """(digest, keep_id, n) of rows (doc_id, digest): memtables flush sorted runs, compactions merge them level by level, keeping the smallest id.

    Each memtable and each compaction sums before its shuffle, so a digest that a third of all rows share is one entry a task.
    """
    at = shared.path(rows.sparkSession, "digest-index")
    level = rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).cast("int").alias("run"), "digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    runs = _flush(level.select("digest", "keep_id", "n", "run"), f"{at}/level0")
    left, number = memtables, 0
    while left > 1:
        left, number = -(-left // FANOUT), number + 1
        merged = runs.groupBy(F.floor(F.col("run") / FANOUT).cast("int").alias("run"), "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        runs = _flush(merged.select("digest", "keep_id", "n", "run"), f"{at}/level{number}")
    return runs.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtables: int = MEMTABLES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after each run of white space became one space; a null
    text equals an empty one. Of equal texts the smallest id stays. Each hit of the index is
    compared with the text of the row that stays, byte by byte; texts that share a digest but
    differ form groups of their own. Rows with a null id never stay before rows with one; rows that
    repeat an id are all counted, and all are kept if the id is. An empty table gives an empty result. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    index = build_index(rows.select("doc_id", "digest"), memtables)
    repeated = shared.written(index.where("n > 1"), "repeated-digests")
    bits = shared.filter_of(repeated, F.col("digest"))
    rows = shared.written(rows.withColumn("maybe", shared.maybe_in(F.col("digest"), bits)).select("doc_id", "digest", "maybe", F.when(F.col("maybe"), F.col("norm")).alias("hit")), "digest-rows")

    alone = rows.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    found = shared.spread_join(rows.where("maybe").drop("maybe"), repeated, ["digest"], repeated, ["doc_id"], "left")
    # What the filter let through in vain stands once.
    found = shared.written(found.select("doc_id", "digest", "hit", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n")), "digest-hits")
    held = found.where((F.col("n") > 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("hit").alias("held"))
    seen = shared.spread_join(found, shared.written(held, "kept-texts"), ["digest"], repeated, ["doc_id"], "left").withColumn("other", F.when((F.col("n") > 1) & (F.col("hit") != F.col("held")), F.col("hit")))
    # What shares a digest and isn't equal: none in practice, and then two empty joins.
    seen = shared.written(seen.drop("hit", "held"), "digest-seen")
    others = shared.written(seen.where(F.col("other").isNotNull()).groupBy("digest", "other").agg(F.min("doc_id").alias("other_keep"), F.count("*").alias("n")), "digest-others")
    less = shared.written(others.groupBy("digest").agg(F.sum("n").alias("less")), "digest-less")
    out = shared.spread_join(seen, others.withColumnRenamed("n", "other_n"), ["digest", "other"], others, ["doc_id"], "left")
    out = shared.spread_join(out, less, ["digest"], less.withColumnRenamed("less", "n"), ["doc_id"], "left")
    keep = F.when(F.col("other").isNull(), F.col("keep_id")).otherwise(F.col("other_keep"))
    size = F.when(F.col("other").isNull(), F.col("n") - F.coalesce("less", F.lit(0))).otherwise(F.col("other_n"))
    out = out.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest")
    return alone.unionByName(out).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
