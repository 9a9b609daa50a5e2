"""Toxicity by non-negative positive-unlabelled learning on hashed words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import shared
from tickloom.llm import text as T

BUCKETS = 1 << 18
#: The classifier is fitted on about so many positive and so many unlabelled documents, whole, drawn by a hash of their ids.
MOST_POSITIVE, MOST_UNLABELLED = 6_000, 18_000
STEPS, RATE, DECAY = 300, 0.05, 1e-5
#: Hashed words that all drawn documents have together, at most; where they have more, fewer are drawn by a hash of their words. The driver holds 4 bytes of each.
MOST_WORDS = 1 << 26
#: Words of drawn documents that the driver sums at once.
PART = 1 << 16
#: Standard deviations at which a word counts by half. SURE and DECAY were the best of nine pairs on one quarter of the training rows after fits on the other three.
SURE = 3.0


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each distinct hashed word, its bucket)."""
    for lo, hi, data, at in T.slices(column):
        _, _, first, (h,) = T.words(data, at, T.PLAIN)
        row, bucket = T.distinct(T.rows_of(np.arange(len(h)), first), (h >> np.uint64(46)).astype(np.int64))
        yield lo, hi, row, bucket


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, row, bucket in _words(batch.column(0)):
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            bags = [np.sort(bucket[a:b]).astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1)[lo:hi], pa.array(bags, pa.binary())], ["positive", "words"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, in_p, in_u): of how many positive and unlabelled bags of a task each bucket is a part."""
    n = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for positive, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n[0 if positive else 1][np.frombuffer(words.as_buffer(), "<i4")] += 1
    at = np.flatnonzero(n.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], ["bucket", "in_p", "in_u"])


class Bags:
    """Documents' words end to end, as ranks among the words that are learned; sums over them need memory for a part at a time."""

    def __init__(self, bags: list[np.ndarray], seen: int):
        self.words = np.concatenate(bags) if bags else np.zeros(0, np.int32)
        self.at = np.r_[0, np.cumsum([len(b) for b in bags])].astype(np.int64)
        self.seen = seen

    def _parts(self) -> Iterator[tuple[int, int]]:
        lo = 0
        while lo < len(self.at) - 1:
            hi = max(lo + 1, int(np.searchsorted(self.at, self.at[lo] + PART, "right")) - 1)
            yield lo, hi
            lo = hi

    def _words(self, lo: int, hi: int) -> np.ndarray:
        return self.words[self.at[lo] : self.at[hi]].astype(np.int64)

    def of_documents(self, w: np.ndarray) -> np.ndarray:
        """The sum of its words' w for each document."""
        out = np.zeros(len(self.at) - 1)
        for lo, hi in self._parts():
            has = np.flatnonzero(self.at[lo + 1 : hi + 1] > self.at[lo:hi])
            if len(has):
                out[lo + has] = np.add.reduceat(w.take(self._words(lo, hi)), self.at[lo + has] - self.at[lo])
        return out

    def of_words(self, g: np.ndarray) -> np.ndarray:
        """The sum of its documents' g for each word."""
        out = np.zeros(self.seen)
        for lo, hi in self._parts():
            out += np.bincount(self._words(lo, hi), np.repeat(g[lo:hi], np.diff(self.at[lo : hi + 1])), self.seen)
        return out


def risk(z: np.ndarray, n_p: int, prior: float) -> tuple[float, float, np.ndarray]:
    """(risk of positives, estimated risk of negatives, gradient to step along by document) of scores z, the first n_p of positives.

    The risk of positives is prior * mean(loss(+)); that of negatives is estimated from unlabelled documents as mean(loss(-) over
    unlabelled) - prior * mean(loss(-) over positives). While this estimate is below 0, which the true risk cannot be, the step goes
    against its gradient instead.
    """
    n_u = len(z) - n_p
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss_neg = np.logaddexp(0, z)
    negative = loss_neg[n_p:].mean() - prior * loss_neg[:n_p].mean()
    g_pos = np.r_[prior * (p[:n_p] - 1) / n_p, np.zeros(n_u)]
    g_neg = np.r_[-prior * p[:n_p] / n_p, p[n_p:] / n_u]
    return prior * np.logaddexp(0, -z[:n_p]).mean(), negative, g_pos + g_neg if negative >= 0 else -g_neg


def surely(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """How much a word counts: by how sure its excess or lack in the positives is, in standard deviations. Noise is shrunk, a word of more data isn't, however rare."""
    expected = n_p * in_u / n_u
    sure = (in_p - expected) ** 2 / (expected + 1)
    return sure / (SURE**2 + sure) / np.sqrt(np.log1p(in_p + in_u) + 1.0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], in_p: np.ndarray, in_u: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(weights by word, bias) of a linear classifier that lessens the non-negative PU risk with the logistic loss, by Adam's steps.

    Bags hold ranks of words; in_p and in_u tell in how many bags each is.
    """
    if not positive or not unlabelled:
        return np.zeros(len(in_p)), -10.0
    n_p = len(positive)
    value = surely(in_p, in_u, n_p, len(unlabelled))
    bags = Bags(positive + unlabelled, len(in_p))
    v, m1, m2, mb, vb = np.zeros(len(in_p)), np.zeros(len(in_p)), np.zeros(len(in_p)), 0.0, 0.0
    bias = float(np.log(prior / (1 - prior)))
    for step in range(1, steps + 1):
        _, _, g = risk(bags.of_documents(v * value) + bias, n_p, prior)
        gv = value * bags.of_words(g) + DECAY * v
        gb = g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * gv, 0.999 * m2 + 0.001 * gv * gv
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        v -= RATE * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        bias -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    # Shrunk weights pull scores to the bias; the cut at 0 is put where as many unlabelled documents are above it as the prior says.
    z = bags.of_documents(v * value)[n_p:]
    return v * value, -float(np.quantile(z, 1 - prior))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weights by bucket, bias) from docs (doc_id, text) and labels (doc_id, toxic), both of training rows only.

    Confirmed toxic documents are the positives; all documents, whatever their label, are drawn as unlabelled. The class prior
    is the toxic share of the labelled rows. Tasks turn the bounded draw into bags of hashed words and count them; the driver gets the
    counts of at most BUCKETS words, and the bags: MOST_WORDS words at most. Words that only unlabelled documents have count too. Rows with a null id or label teach nothing as positives.
    """
    spark = docs.sparkSession
    labels = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n, toxic = labels.agg(F.count("*"), F.sum("toxic")).first()
    total = docs.count()
    if not n or not toxic or not total:
        return np.zeros(BUCKETS), -10.0
    # Rows without an id are drawn by their texts.
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text")), F.lit("pu")), F.lit(1 << 30))
    yes = labels.where("toxic = 1").where(F.pmod(F.xxhash64(F.col("l_id"), F.lit("p")), F.lit(1 << 30)) < int(min(1.0, MOST_POSITIVE / toxic) * (1 << 30)))
    texts = docs.select("doc_id", "text")
    # About MOST_POSITIVE ids at any size of the input: they are sent to the texts, which stay where they are.
    positive = texts.join(F.broadcast(yes), F.col("doc_id") == F.col("l_id"), "left_semi").select("text", F.lit(True).alias("positive"))
    unlabelled = texts.where(at < int(min(1.0, MOST_UNLABELLED / total) * (1 << 30))).select("text", F.lit(False).alias("positive"))
    bags = shared.written(positive.unionByName(unlabelled).mapInArrow(_bags, "positive boolean, words binary"), "pu-bags")
    held = bags.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if held > 4 * MOST_WORDS:
        bags = bags.where(F.pmod(F.xxhash64("words"), F.lit(1 << 30)) < int(4 * MOST_WORDS / held * (1 << 30)))
    counts = bags.mapInArrow(_counted, "bucket long, in_p long, in_u long").groupBy("bucket").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    counts = counts.orderBy("bucket").toPandas()
    seen = counts.bucket.to_numpy(np.int64)
    rank = np.full(BUCKETS, -1, np.int32)
    rank[seen] = np.arange(len(seen), dtype=np.int32)
    sent = spark.sparkContext.broadcast(rank)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = [sent.value[np.frombuffer(x.as_buffer(), "<i4")] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[r >= 0].astype("<i4").tobytes() for r in ranks], pa.binary())], ["positive", "words"])

    both: tuple[list, list] = ([], [])
    for row in bags.mapInArrow(kept, "positive boolean, words binary").toLocalIterator():
        both[0 if row.positive else 1].append(bytes(row.words))
    # Sums of floats depend on the order; sorted bags make reruns agree.
    p, u = ([np.frombuffer(x, "<i4") for x in sorted(side)] for side in both)
    w = np.zeros(BUCKETS)
    w[seen], bias = fit(p, u, counts.in_p.to_numpy(), counts.in_u.to_numpy(), min(max(toxic / n, 1e-4), 0.9))
    return w, bias


def score(docs: DataFrame, weights: np.ndarray, bias: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *extra, score, predicted) of every row of docs, from its whole text.

    A null or empty text has no words and gets the score of the bias. Extra columns pass as they are. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))
    kept = ["doc_id", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            z = np.full(batch.num_rows, b)
            for lo, hi, row, bucket in _words(batch.column(0)):
                z[lo:hi] += np.bincount(row, w[bucket], hi - lo)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select("text", *kept).mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in kept], "score double", "predicted int"]))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the rows that aren't held out, told of all rows."""
    w, b = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), w, b, ("held_out",))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
