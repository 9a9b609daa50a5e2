"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets that n-grams are hashed to, and the n.
BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
#: The model is fitted on about this many labelled documents, whole, drawn by a hash of their ids.
MOST_TRAIN = 20_000
_CHARS = 1 << 18

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """By code point: whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams, the text each is of, whether each text has a letter).

    Letters are lower-cased, each run of anything else is one space; n-grams are of characters, within one text.
    """
    low = [t.lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low)) + 2
    c = np.frombuffer(" ".join(["", *[f"{t} " for t in low]]).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low)), size)
    letter = letter_table()[c]
    has = np.bincount(row, letter, len(low)) > 0
    keep = letter | np.r_[True, letter[:-1]] | np.r_[False, row[1:] != row[:-1]]
    c, row = np.where(letter, c, np.uint32(32))[keep].astype(np.uint64), row[keep]
    buckets, rows = [], []
    h = np.zeros(len(c), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(1)
            if n in ORDERS:
                ok = row[:m] == row[n - 1 :]
                if n == 1:
                    ok &= c != 32
                mixed = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
                buckets.append(mixed[ok].astype(np.int64))
                rows.append(row[:m][ok])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(buckets), np.concatenate(rows), has


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= _CHARS):
            n += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = [t or "" for t in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist(), object)
        for lo, hi in _groups(texts):
            b, row, _ = features(texts[lo:hi])
            for lang in set(langs[lo:hi]):
                n = np.bincount(b[(langs[lo:hi] == lang)[row]], minlength=BUCKETS)
                held[lang] = held[lang] + n if lang in held else n
    for lang, n in held.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])


def train(labelled: DataFrame, most: int = MOST_TRAIN) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, bucket], then log priors as a last column) from rows (doc_id, text, lang).

    About `most` rows are drawn by a hash of their ids, all languages are learned; counts are summed by Spark, and what the
    driver gets is bounded by languages times buckets.
    """
    labelled = labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    per = labelled.groupBy("lang").agg(F.count("*").alias("docs")).orderBy("lang").toPandas()
    if per.empty:
        return [], np.zeros((0, BUCKETS + 1))
    langs = sorted(per.lang)
    share = min(1.0, most / per.docs.sum())
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit("train")), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = labelled.where(drawn).select("text", "lang")
    counts = rows.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.full((len(langs), BUCKETS), 0.5)
    if len(counts):
        np.add.at(n, (counts.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(), counts.bucket.to_numpy()), counts.n.to_numpy())
    prior = per.set_index("lang").docs.reindex(langs).to_numpy()
    return langs, np.c_[np.log(n / n.sum(1, keepdims=True)), np.log(prior / prior.sum())]


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *extra, lang_pred, score) of every row of docs; score is the posterior of lang_pred.

    A null text, one without a letter and any text without a model give `und` with score 0. Whole texts are read, a
    very long one alone. Extra columns pass as they are. An empty table gives an empty result.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast((langs, model.astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = shared_model.value
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for lo, hi in _groups(texts) if names else ():
                b, row, has = features(texts[lo:hi])
                # a sparse matrix of counts times the log probabilities, a language at a time
                s = np.stack([np.bincount(row, m[k, b], hi - lo) for k in range(len(names))], 1) + m[:, -1]
                s = np.exp(s - s.max(1, keepdims=True))
                best = s.argmax(1)
                pred[lo:hi][has] = np.array(names, object)[best][has]
                score[lo:hi][has] = (1 / s.sum(1))[has]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score)], [*out[:-2], "lang_pred", "score"])

    kept = ["doc_id", *extra]
    out = [*kept, "lang_pred", "score"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in kept], "lang_pred string", "score double"])
    return docs.select("text", *kept).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    langs, model = train(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), langs, model, ("held_out",))


__all__ = ["features", "letter_table", "predict", "query", "train"]
