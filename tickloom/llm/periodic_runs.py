"""Periodic runs of words: an all-lag scan of word-id arrays, in numpy.

For each lag up to n / exponent the array is compared with itself shifted, and true stretches are measured. A stretch of s words covers a multiple of s / 4
at least four times, so the shifted arrays meet at those places first, and word by word only around four hits in a row: no stretch is missed, and a document
of n words costs n log n instead of n squared. Short documents are scanned many at once; the lags of a long one are dealt out as ranges, which Spark spreads over machines.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import shared

#: A run has at least so many words, and repeats its period at least so many times.
LEAST, EXPONENT = 6, 4
#: Lags of a document that one task scans; a document with more is dealt to several tasks, at most PIECES.
LAGS, PIECES = 2_048, 64
#: Words scanned at once.
TOGETHER = 1 << 17

SPACE = r"[\x20\x09-\x0D]+"
_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def _smallest_period(x: np.ndarray, q: int) -> int:
    """The smallest period of x, which has period q and at least two of them: it divides q."""
    d = q
    for p in _primes(q):
        while d % p == 0 and np.array_equal(x[: -(d // p)], x[d // p :]):
            d //= p
    return d


def _groups(x: np.ndarray, q: int, s: int) -> Iterator[tuple[int, int]]:
    """(first, last) of groups of places p, evenly apart, with x[p] = x[p + q]: each stretch of s such places or more holds a whole group and reaches no further than to the places beside it."""
    t = max(1, s // 4)
    k, m = s // t, len(x) - q
    hit = np.flatnonzero(x[:m:t] == x[q::t])
    if len(hit) < k or not (hit[k - 1 :] - hit[: len(hit) - k + 1] == k - 1).any():
        return
    cut = np.flatnonzero(np.diff(hit) != 1) + 1
    opens, closes = np.r_[0, cut], np.r_[cut, len(hit)]
    for i in np.flatnonzero(closes - opens >= k):
        yield int(hit[opens[i]]) * t, int(hit[closes[i] - 1]) * t


def scan(x: np.ndarray, ends: np.ndarray, low: int = 1, high: int | None = None, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with periods from low to high. x holds documents one after another, longest first, that end at `ends` and share no id."""
    sizes = np.diff(np.r_[0, ends])
    found, covers, owner = [], [], np.full(len(x), -1, np.int32)
    for q in range(low, (int(sizes[0]) // exponent if high is None else high) + 1) if len(sizes) else ():
        need = max(least, exponent * q)
        of = int(np.searchsorted(-sizes, -need, "right"))
        if not of:
            break
        part, s = x[: ends[of - 1]], need - q
        t = max(1, s // 4)
        for first, last in _groups(part, q, s):
            if _covered(covers, owner, first, last + q + 1, q):
                continue
            a, b = max(0, first - t + 1), min(len(part) - q, last + t)
            edge = np.diff(np.r_[False, part[a:b] == part[a + q : b + q], False].astype(np.int8))
            for lo, hi in zip(a + np.flatnonzero(edge == 1), a + np.flatnonzero(edge == -1), strict=True):
                if hi - lo < s or _covered(covers, owner, lo, hi + q, q):
                    continue
                d = _smallest_period(part[lo : hi + q], q)
                owner[lo : hi + q] = len(covers)
                covers.append((lo, hi + q, d))
                if d == q:
                    found.append((int(lo), int(hi + q - lo), q))
    return found


def _covered(covers: list[tuple[int, int, int]], owner: np.ndarray, a: int, b: int, q: int) -> bool:
    """Whether words a to b are within a known stretch of a period that divides q: q isn't their smallest period, and at lag q that stretch has the same ends."""
    i = owner[(a + b) // 2]
    return i >= 0 and q % covers[i][2] == 0 and covers[i][0] <= a and b <= covers[i][1]


def _ids(words: list[list[bytes]]) -> np.ndarray:
    """A number for each word, the same for equal bytes."""
    return pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _split(texts: pa.Array) -> list[list[bytes]]:
    """Words of each text; bytes part at the six ASCII white spaces alone."""
    return [t.split() if t else [] for t in pc.cast(texts, pa.binary()).to_pylist()]


def runs_of(words: list[list[bytes]], low: int = 1, high: int | None = None) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, by start and period. Documents are scanned together, in groups of about TOGETHER words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    order = sorted((i for i, w in enumerate(words) if len(w) >= LEAST), key=lambda i: -len(words[i]))
    at = 0
    while at < len(order):
        group, total = [], 0
        while at < len(order) and (not group or total + len(words[order[at]]) <= TOGETHER):
            group.append(order[at])
            total += len(words[order[at]])
            at += 1
        sizes = np.array([len(words[i]) for i in group])
        ends = np.cumsum(sizes)
        x = _ids([words[i] for i in group]) * len(group) + np.repeat(np.arange(len(group)), sizes)
        for start, length, period in scan(x, ends, low, high):
            doc = int(np.searchsorted(ends, start, "right"))
            out[group[doc]].append((start - int(ends[doc] - sizes[doc]), length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(compress(words, np.cumsum(edge[:-1]) == 0))


def _rows(ids: pa.Array, words: list, runs: list) -> pa.RecordBatch:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    lists = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in one] for one in runs], pa.list_(run))
    texts = pa.array([_collapsed(w, r).decode("utf-8", "replace") for w, r in zip(words, runs, strict=True)], pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in words], pa.int64()), lists, texts], ["doc_id", "n_words", "runs", "collapsed"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, text) that one task scans at all lags."""
    for batch in batches:
        words = _split(batch.column(1))
        yield _rows(batch.column(0), words, runs_of(words))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of lags (key, text, low, high) of long documents."""
    for batch in batches:
        of = defaultdict(list)
        for key, text, low, high in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            of[low, high].append((key, text.encode().split()))
        for (low, high), docs in of.items():
            found = [(key, *r) for (key, _), runs in zip(docs, runs_of([w for _, w in docs], low, high), strict=True) for r in runs]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), *(pa.array([r[k] for r in found], pa.int64()) for k in (1, 2, 3))], ["key", "start", "length", "period"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long documents (doc_id, text, runs) whose runs are known."""
    for batch in batches:
        runs = [[(r["start"], r["length"], r["period"]) for r in one or []] for one in batch.column(2).to_pylist()]
        yield _rows(batch.column(0), _split(batch.column(1)), runs)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lags: int = LAGS, bytes_col: str | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of docs.

    runs are the maximal stretches of words with a smallest period q, of at least LEAST words and EXPONENT periods, as (start, length, period) by start and
    period; collapsed is the text without what any run repeats after its first period, words joined by one space. A null text has no words. Rows that repeat
    an id, or have none, each have their own result; an empty table gives an empty result; other columns aren't read. Texts of more
    than 8 * EXPONENT * lags bytes (or `bytes_col`, a number of bytes that as many words have at least, where it is cheaper to know) are scanned once
    however often they are repeated, in ranges of lags of equal width.
    """
    size = F.octet_length(text_col) if bytes_col is None else F.col(bytes_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(size, F.lit(0)).alias("bytes"))
    # A word has a byte and a white space at least, so what is scanned whole has no more than 4 * lags lags.
    long = F.col("bytes") > 8 * EXPONENT * lags
    schema = f"doc_id long, n_words long, runs array<{_RUN}>, collapsed string"
    short = rows.where(~long).select("doc_id", "text").mapInArrow(_whole, schema)
    keyed = shared.written(rows.where(long).select("doc_id", "text", F.sha2("text", 256).alias("key")), "long-texts")
    most = F.floor(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) / EXPONENT).cast("int")
    texts = keyed.groupBy("key").agg(F.first("text").alias("text")).withColumn("most", most).where("most > 0")
    width = F.greatest(F.lit(lags), F.ceil(F.col("most") / PIECES)).cast("int")
    pieces = texts.select("key", "text", "most", width.alias("width")).select("key", "text", "most", "width", F.explode(F.expr("sequence(1, most, width)")).alias("low"))
    pieces = pieces.select("key", "text", "low", F.least(F.col("low") + F.col("width") - 1, F.col("most")).alias("high")).repartition("key", "low")
    found = pieces.mapInArrow(_ranges, "key string, start long, length long, period long")
    lists = found.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "period", "length"))), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    joined = shared.spread_join(keyed, shared.written(lists, "periodic-runs"), ["key"], keyed.groupBy("key").agg(F.count("*").alias("n")), ["doc_id"], "left")
    return short.unionByName(joined.select("doc_id", "text", "runs").mapInArrow(_joined, schema))


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) of which one in ten, by its id's CRC-32, repeats a stretch of its own words up to its end; bytes are those of the text before, which has as many words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))).withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    # Whole arrays are cut and repeated: a lambda over positions could be given the splitting of the text at each of them.
    again = F.expr("array_join(concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int(ceil((n - a) / p)))), 1, int(n - a))), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"), F.octet_length("text").alias("bytes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), bytes_col="bytes")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = out.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    exponent = F.expr("floor(1000 * -best.less / best.period)")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        exponent.cast("long").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
