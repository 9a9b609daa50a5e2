"""A corpus pipeline of training-data operators: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, jaccard_join, mixing, shared, token_output, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words in a shingle of the near-copy stage, and per cent of two documents' shingles in common that link them.
SHINGLE, ALIKE = 5, 80


def known(docs: DataFrame) -> DataFrame:
    """docs with _node, a hash of id and text, so that different texts of one id are judged apart, and _tie, a hash of text and all else: rows that agree in both are the same row repeated."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_node"), F.xxhash64("text", "lang", "source", "n_chars").alias("_tie"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't find toxic, whatever their ids. It is learned from rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    w, b = toxicity.train(docs.where(~toxicity.held_out()), labels.where(~toxicity.held_out()))
    return toxicity.score(docs.select(*COLUMNS).withColumn("body", F.col("text")), w, b, ("body", "lang", "source", "n_chars")).where("predicted = 0").select("doc_id", F.col("body").alias("text"), "lang", "source", "n_chars")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: of the smallest id, rows without one after all others. Different texts of one id are different nodes. Texts without words stay."""
    rows = known(docs)
    copies = jaccard_join.repeated(rows, SHINGLE, ALIKE, "doc_id", "text", "_tie", "_node").select(F.col("node").alias("_node"), F.col("tie").alias("_tie"), "stays")
    # Rows that nothing repeats stay without a shuffle; the filter may send more of them than copies has.
    asked = shared.maybe_in(F.col("_node"), shared.filter_of(copies, F.col("_node"))) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    met = rows.where(asked).join(copies.hint("merge"), ["_node", "_tie"], "left").where(F.coalesce("stays", F.lit(True)))
    return rows.where(~asked).select(*COLUMNS).unionByName(met.dropDuplicates(["_node", "_tie"]).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item that isn't short. Each text is judged for itself, whatever its id."""
    rows = known(docs)
    found = decontamination.matches(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_node").where("not short").select(F.col("doc_id").alias("_node")).distinct()
    return rows.join(found.hint("merge"), "_node", "left_anti").select(*COLUMNS)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, rows without an id too. Of rows repeated in all columns, one stands for all with the sum of their copies."""
    rows = known(docs)
    mixed = mixing.mix(rows, mixing.label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")), id_col="_node", extra=("_tie",))
    copies = mixed.where("copies > 0").groupBy(F.col("doc_id").alias("_node"), "_tie").agg(F.sum("copies").cast("int").alias("copies"))
    taken = rows.join(copies.hint("merge"), ["_node", "_tie"]).dropDuplicates(["_node", "_tie"])
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files: doc_id, start, n_tokens, ids_crc32."""
    return token_output.tokenised(docs, token_output.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", to_target_weights),
    ("token-ID output", to_tokens),
]

#: Classifiers and tokenizers are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
