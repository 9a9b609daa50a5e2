"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm import shared

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) of (source, source_size): `share` of all words dealt by weight, no target above `most_epochs` times its source.

    Sources by code point, null last, take the weights in turn. In the order of cap / weight the
    sources that reach their caps come first, so one pass of running sums finds the level at which
    the rest share what the capped ones leave. The table has a row a source: the windows over all of it see
    only the sums of the sources, never their documents.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most_epochs)) * F.col("source_size")).withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("open", F.col("cap") / F.col("w") >= F.col("level"))
    level = F.min_by("level", F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")))).over(everything)
    return s.withColumn("fill", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("fill") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies.

    Each source takes whole epochs first; for what is left, its documents are drawn without
    replacement with chances by quality weight (exponential keys, -ln(u) / weight, in ascending order), until their
    words reach the target. `taken` counts words and cuts the last drawn document at the target;
    `copies` counts whole documents and draws the last one if at least half of it fits. u comes
    from a digest of the seed and the id, so reruns agree. quality: (doc_id, weight), missing or not above
    0: weight 1. A null text has no words; a null source is a source of its own, the last. Rows that repeat
    an id get the same key and are ordered by size, then by an arbitrary number. An empty table gives an empty result.
    Columns named in `extra` pass as they are.
    """
    rows = docs.select(*extra, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    if quality is not None:
        best = quality.where(F.col("weight") > 0).groupBy(F.col("doc_id").alias("q_id")).agg(F.max("weight").alias("weight"))
        rows = rows.join(best, F.col("doc_id") == F.col("q_id"), "left").drop("q_id")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("key", -F.log(u) / F.coalesce(F.col("weight").cast("double"), F.lit(1.0))).drop("weight")
    rows = shared.written(rows.withColumn("tie", F.monotonically_increasing_id()), "mix-rows")
    targets = shared.written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_epochs), "mix-targets")
    ordered = shared.running_total(rows, ["source"], ["key", "doc_id", "size", "tie"], "size", "before").drop("tie")
    t = targets.withColumnRenamed("source", "s")
    out = ordered.join(t, ordered["source"].eqNullSafe(t["s"])).drop("s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    whole = (F.col("size") > 0) & (2 * (F.col("rest") - F.col("before")) >= F.col("size"))
    return out.select(*extra, "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), (F.col("epochs") + whole.cast("int")).cast("int").alias("copies"))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): good documents are drawn four times as readily as bad ones; those without a label are between."""
    return labels.where(F.col("quality").isNotNull()).select("doc_id", F.when(F.col("quality") > 0, 2.0).otherwise(0.5).alias("weight"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return mixed.drop("copies")


SQL = r"""
WITH q AS (
  SELECT doc_id, max(CASE WHEN quality > 0 THEN 2.0 ELSE 0.5 END)::DOUBLE AS weight FROM labels WHERE quality IS NOT NULL GROUP BY 1
), d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix-1' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(weight, 1.0) AS key
  FROM documents LEFT JOIN q USING (doc_id)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY 1
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS n
  FROM c WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, n) FROM l WHERE cap / w >= level) * w, cap)) AS target FROM l
), o AS (
  SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM o
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM e
"""
