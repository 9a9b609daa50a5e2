"""Quality by the perplexity of an interpolated modified Kneser-Ney bigram model that is trained on trusted text.

Every trusted document is counted, and every bigram and word of it is in the model, those seen once with their own discount. With g(v) the log weight that v
leaves to the lower order and u(w) the log probability of w there, a document's log probability is the sum over its words of g + u, and of
a correction for each bigram in the model. So all of the model is one table (key, delta), keyed by hashes of words and of bigrams, and scoring is a
join of counts with it. The most frequent keys, a bounded number, are sent to all tasks; documents ask for the others by shards: what a slice of
documents asks of a shard is one packed row, and what comes back are sums.

Where trusted text is large, contexts are dealt into parts by their hashes. Each part is counted on its own, and each is scored on its own, with a reading of the
texts each time: what is on disk at once besides the bigrams is one part's, and the sums of the parts are those of the whole model.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm import shared
from tickloom.llm import text as T

#: Share of each language's documents that stay.
KEEP = 0.9
#: Entries of the model that are sent to all tasks at most.
HEAD = 1 << 20
#: Bigrams a task holds before it hands them on, salts over which the followers of one word are spread, bits of the filter, bytes of text that ask together, entries a shard has about.
HELD, SALTS, FILTER_BITS, SLICE, SHARD = 1 << 21, 16, 1 << 25, 4 << 20, 1 << 20
#: Parts of the contexts at most, and bytes of trusted text for which there is one more.
PARTS, PART_BYTES = 4, 16 << 20
#: Begin and end of a document among the words' hashes.
BEGIN, END = 0, 1
#: Log probabilities are sums of integers in this unit, so they don't depend on the order of addition.
UNIT = 1 << 16
#: Counts are told apart up to this one when the head is chosen.
_MOST = 1 << 12
_U = np.uint64


def _sequences(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, row) of each bigram of rows with words, begin and end included."""
    n = np.diff(first)
    r = np.flatnonzero(n)
    n = n[r]
    at = np.cumsum(n + 2) - n - 2
    seq = np.empty(int(n.sum()) + 2 * len(r), _U)
    inner = np.ones(len(seq), bool)
    inner[at] = inner[at + n + 1] = False
    seq[inner] = np.maximum(h, _U(2))
    seq[at], seq[at + n + 1] = BEGIN, END
    ok = np.ones(max(0, len(seq) - 1), bool)
    ok[(at + n + 1)[:-1]] = False
    return seq[:-1][ok], seq[1:][ok], np.repeat(r, n + 1)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return T.mixed(v * _U(T.BASES[0]) ^ T.mixed(w))


def _shard_of(v: np.ndarray, shards: int) -> np.ndarray:
    return (T.mixed(v) % _U(shards)).astype(np.int64)


def _part_of(v: np.ndarray, parts: int) -> np.ndarray:
    return (v >> _U(32)) % _U(parts)


def _eight(x: np.ndarray) -> bytes:
    return x.astype("<u8").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8").astype(_U)


def _squeezed(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<i8").reshape(-1, 1).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unsqueezed(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).reshape(-1).view("<i8")


def _summed(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (v, w) as one, with the sum of their counts, sorted by both."""
    order = np.lexsort((w, v))
    v, w, c = v[order], w[order], c[order]
    opens = np.flatnonzero(np.r_[len(v) > 0, (v[1:] != v[:-1]) | (w[1:] != w[:-1])][: len(v)])
    return v[opens], w[opens], np.add.reduceat(c, opens) if len(opens) else c


def _counted(shards: int, part: int, parts: int):
    """Bigrams of whole texts with a context of the part, summed in the task, as rows (shard, contexts, followers of each, words, counts)."""
    names = ["shard", "v", "runs", "w", "c"]

    def rows(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            shard = _shard_of(v * _U(SALTS) + (T.mixed(w) & _U(SALTS - 1)), shards)
        order = np.argsort(shard, kind="stable")
        v, w, c, shard = v[order], w[order], c[order], shard[order]
        out: list[list] = [[] for _ in names]
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            opens = np.flatnonzero(np.r_[True, v[lo + 1 : hi] != v[lo : hi - 1], True])
            for k, x in enumerate((int(shard[lo]), _eight(v[lo:hi][opens[:-1]]), _squeezed(np.diff(opens)), _eight(w[lo:hi]), _squeezed(c[lo:hi]))):
                out[k].append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for _, _, data, at in T.slices(batch.column(0)):
                _, _, first, (h,) = T.words(data, at, T.LOWER)
                v, w, _ = _sequences(h, first)
                if parts > 1:
                    mine = np.flatnonzero(_part_of(v, parts) == part)
                    v, w = v[mine], w[mine]
                held.append((v, w, np.ones(len(v), np.int64)))
                size += len(v)
                if size >= HELD:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield rows(*held[0])
                        held, size = [], 0
        if size:
            yield rows(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return run


_REDUCED = "kind string, a long, b long, c long, shard int, words binary, stats binary"


def _blobs(kind: str, shard: list[int], words: list[bytes], stats: list[bytes]) -> pa.RecordBatch:
    n = len(shard)
    none = [pa.nulls(n, pa.int64())] * 3
    return pa.RecordBatch.from_arrays([pa.array([kind] * n), *none, pa.array(shard, pa.int32()), pa.array(words, pa.binary()), pa.array(stats, pa.binary())], [f.split()[0] for f in _REDUCED.split(", ")])


def _entries(kind: str, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(a), 1 << 17):
        x = [pa.array(T.signed(y[lo : lo + (1 << 17)]) if y.dtype == _U else y[lo : lo + (1 << 17)]) for y in (a, b, c)]
        n = len(x[0])
        yield pa.RecordBatch.from_arrays([pa.array([kind] * n), *x, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], [f.split()[0] for f in _REDUCED.split(", ")])


def _histogram(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, _MOST), minlength=_MOST + 1)


def _reduced(shards: int):
    """From a task's shards: bigrams, sums for each of their words, and how often counts occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            for v, runs, w, c in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                parts.append((np.repeat(_unpacked(v), _unsqueezed(runs)), _unpacked(w), _unsqueezed(c)))
        if not parts:
            return
        v, w, c = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        parts.clear()
        yield _blobs("pairs", [0], [b""], [_squeezed(_histogram(c))])
        yield from _entries("pair", v, w, c)
        # Columns: distinct contexts before, and distinct followers seen once, twice and oftener, and all followers.
        words, at = np.unique(np.concatenate([v, w]), return_inverse=True)
        after, before = at[: len(v)], at[len(v) :]
        stats = [np.bincount(before, minlength=len(words)), *(np.bincount(after, ok, len(words)).astype(np.int64) for ok in (c == 1, c == 2, c > 2)), np.bincount(after, c, len(words)).astype(np.int64)]
        shard = _shard_of(words, shards)
        # Words ascend in each blob, so their steps have fewer bytes.
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True])
        blobs = [(int(shard[order[lo]]), _squeezed(np.diff(words[order[lo:hi]], prepend=_U(0)).view(np.int64)), _squeezed(np.concatenate([s[order[lo:hi]] for s in stats]))) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        yield _blobs("word", *map(list, zip(*blobs, strict=True)))

    return run


_WORDS = "word long, before long, n1 long, n2 long, n3 long, total long, hist binary"


def _word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _WORDS.split(", ")]
    words, stats = [], []
    for batch in batches:
        for x, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words.append(np.cumsum(_unsqueezed(x).view(_U), dtype=_U))
            stats.append(_unsqueezed(s).reshape(5, -1))
    if not words:
        return
    seen, at = np.unique(np.concatenate(words), return_inverse=True)
    each = np.concatenate(stats, 1)
    sums = [np.bincount(at, x, len(seen)).astype(np.int64) for x in each]
    before, total = sums[0], sums[4]
    said = seen != BEGIN
    # How often counts of contexts before and of words occur.
    hist = np.r_[_histogram(before[said]), before.sum(), _histogram(total)]
    yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 6, pa.array([_squeezed(hist)], pa.binary())], names)
    for lo in range(0, len(seen), 1 << 17):
        k = slice(lo, lo + (1 << 17))
        yield pa.RecordBatch.from_arrays([pa.array(T.signed(seen[k])), *[pa.array(s[k]) for s in sums], pa.nulls(len(seen[k]), pa.binary())], names)


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Chen and Goodman's discounts of counts 1, 2 and above from the number of counts 1 to 4; a half of the count at most where too few tell."""
    n1, n2, n3, n4 = (float(x) for x in n[1:5])
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class Model:
    """(key, delta, often) of a trained model as a table for each part of the contexts, and the numbers that all documents share. Tables are read from the parts' `counts` and from `words`."""

    def __init__(self, parts: list[DataFrame], unknown: int, ends: int, hist: np.ndarray, counts: list[DataFrame], words: DataFrame):
        self.parts, self.unknown, self.ends, self.hist, self.counts, self.words = parts, unknown, ends, hist, counts, words

    @property
    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def least(self, head: int) -> int:
        """The smallest count whose entries and all of larger counts are at most `head`."""
        above = np.cumsum(self.hist[::-1])[::-1]
        return int(np.argmax(np.r_[above, 0] <= head))


def train(trusted: DataFrame, head: int = HEAD, text_col: str = "text", parts: int | None = None) -> Model | None:
    """The model of all texts of trusted; None where they have no words. `parts` is by their size where it isn't given.

    Texts are written once. Those of each part meet Spark's shuffle once, as packed bigrams that each task has summed. What the driver gets are counts of
    counts, a bounded number of them from each task.
    """
    spark = trusted.sparkSession
    shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = shared.freed(trusted.select(F.col(text_col).alias("text")), "lm-texts", compression="zstd")
    parts = parts or min(PARTS, 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)
    of = [texts.mapInArrow(_counted(shards, k, parts), "shard int, v binary, runs binary, w binary, c binary").repartition(shards, "shard") for k in range(parts)]
    counts = [shared.freed(x.mapInArrow(_reduced(shards), _REDUCED), "lm-pairs") for x in of]
    shared.removed(texts)
    reduced = reduce(DataFrame.unionByName, counts)
    summed = reduced.where("kind = 'word'").select("shard", "words", "stats").repartition(shards, "shard").mapInArrow(_word_sums, _WORDS)
    summed = shared.freed(summed, "lm-words")
    pairs = [_unsqueezed(bytes(r.stats)) for r in reduced.where("kind = 'pairs'").select("stats").toLocalIterator()]
    if not pairs:
        return None
    pairs = np.sum(pairs, 0)
    told = np.sum([_unsqueezed(bytes(r.hist)) for r in summed.where("hist is not null").select("hist").toLocalIterator()], 0)
    befores, n, totals = told[: _MOST + 1], int(told[_MOST + 1]), told[_MOST + 2 :]
    size = int(befores.sum())
    d, e = discounts(pairs), discounts(befores)
    rest = (e[0] * befores[1] + e[1] * befores[2] + e[2] * befores[3:].sum()) / n
    unknown = math.log(rest / (size + 1))

    def less(c: str, by: tuple[float, float, float]):
        return F.col(c) - F.when(F.col(c) == 1, by[0]).when(F.col(c) == 2, by[1]).otherwise(by[2])

    words = summed.where("hist is null")
    left = (F.col("n1") * d[0] + F.col("n2") * d[1] + F.col("n3") * d[2]) / F.col("total")
    words = words.select("word", "total", F.when(F.col("total") > 0, F.log(left)).otherwise(0.0).alias("g"), F.log(F.greatest(less("before", e), F.lit(0.0)) / n + rest / (size + 1)).alias("u"))
    words = shared.freed(words, "lm-word-stats")
    shared.removed(summed)
    follower = words.select(F.col("word").alias("b"), "u")
    seen = less("c", d) / F.col("total")
    delta = F.log(seen + F.exp(F.col("g") + F.col("u"))) - F.col("g") - F.col("u")

    def part(k: int) -> DataFrame:
        own = words.where(F.shiftrightunsigned("word", 32) % parts == k)
        context = own.select(F.col("word").alias("a"), "total", "g")
        met = counts[k].where("kind = 'pair'").select("a", "b", "c").join(context.hint("merge"), "a").join(follower.hint("merge"), "b")
        met = met.select("a", "b", F.round(delta * UNIT).cast("int").alias("delta"), F.col("c").alias("often")).mapInArrow(_keyed, "key long, delta int, often long")
        alone = own.where(~F.col("word").isin(BEGIN, END)).select(F.col("word").alias("key"), F.round((F.col("g") + F.col("u") - unknown) * UNIT).cast("int").alias("delta"), F.col("total").alias("often"))
        return met.unionByName(alone)

    ends = {r.word: (r.g, r.u) for r in words.where(F.col("word").isin(BEGIN, END)).collect()}
    hist = pairs + totals
    hist[0] = 0
    return Model([part(k) for k in range(parts)], round(unknown * UNIT), round((ends[BEGIN][0] + ends[END][1]) * UNIT), hist, counts, words)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(k).to_numpy().view(_U) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(T.signed(pair_key(a, b))), batch.column(2), batch.column(3)], ["key", "delta", "often"])


class Lookup:
    """A hash table from keys to values in numpy, by linear probing; keys are hashes already."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << max(4, (2 * len(keys) - 1).bit_length())) - 1
        self.keys, self.values, self.used = np.zeros(self.mask + 1, _U), np.zeros(self.mask + 1, np.int32), np.zeros(self.mask + 1, bool)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(~self.used[at])
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.values[at[won]], self.used[at[won]] = keys[won], values[won], True
            lost = np.ones(len(keys), bool)
            lost[won] = False
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> _U(24))) & _U(self.mask)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether found); a key that isn't found has 0."""
        out, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            hit = self.keys[at] == keys[open_]
            used = self.used[at]
            hit &= used
            out[open_[hit]], found[open_[hit]] = self.values[at[hit]], True
            on = used & ~hit
            open_, at = open_[on], (at[on] + 1) & self.mask
        return out, found


def log_probabilities(docs: DataFrame, model: Model, head: int = HEAD, extra: tuple[str, ...] = (), spend: bool = False) -> DataFrame:
    """(*extra, n_words, logp in UNITs) of every row of docs (text, *extra), as a table; with `spend` the model's own tables are deleted as they have been read.

    The parts' sums meet by two hashes of the text, on which alone they depend.
    """
    by = ["_text1", "_text2"] if len(model.parts) > 1 else []
    rows = docs.select("text", *extra, *[x.alias(c) for c, x in zip(by, (F.xxhash64("text"), F.xxhash64(F.lit(1), "text")), strict=False)])
    own, *others = [_of_part(rows, model, k, head, (*by, *extra) if k == 0 else tuple(by), spend) for k in range(len(model.parts))]
    if spend:
        shared.removed(model.words)
    if not others:
        return own
    more = reduce(DataFrame.unionByName, others).groupBy(*by).agg(F.sum("logp").alias("_more"))
    all_ = shared.freed(own.join(more.hint("merge"), by).select(*extra, "n_words", (F.col("logp") + F.col("_more")).alias("logp")), "lm-sums")
    shared.removed(own, *others)
    return all_


def _of_part(docs: DataFrame, model: Model, part: int, head: int, extra: tuple[str, ...], spend: bool) -> DataFrame:
    """(*extra, n_words, logp) of every row of docs by the keys of one part; of parts other than the first, each different *extra once."""
    spark = docs.sparkSession
    parts, least = len(model.parts), model.least(head)
    table_ = shared.freed(model.parts[part], "lm-part", compression="zstd")
    if spend:
        shared.removed(model.counts[part])
    top = table_.where(F.col("often") >= least).select("key", "delta")
    top = [(np.frombuffer(bytes(r.k), "<i8"), np.frombuffer(bytes(r.d), "<i4")) for r in top.mapInArrow(_packed, "k binary, d binary").toLocalIterator()]
    keys, values = (np.concatenate([x[k] for x in top]) if top else np.zeros(0, t) for k, t in enumerate((np.int64, np.int32)))
    tail = table_.where(F.col("often") < least).select("key", "delta") if model.hist[:least].any() else None
    shards, bits = max(8, int(model.hist[:least].sum()) // (parts * SHARD) + 1), None
    if tail is not None:
        bit = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
        filled = tail.groupBy(F.floor(bit / 32).cast("long").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (bit % 32).cast("int"))).alias("bits"))
        filled = shared.freed(filled, "lm-filter")
        bits = np.zeros(FILTER_BITS // 32, "<u4")
        for r in filled.mapInArrow(_packed, "k binary, d binary").toLocalIterator():
            bits[np.frombuffer(bytes(r.k), "<i8")] = np.frombuffer(bytes(r.d), "<i4").view("<u4")
        shared.removed(filled)
    sent = spark.sparkContext.broadcast((keys, values, bits))
    unknown, ends = (model.unknown, model.ends) if part == 0 else (0, 0)
    tables: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            k, v, some = sent.value
            tables.append((Lookup(k.view(_U), v), some))
        table, some = tables[0]
        for batch in batches:
            for lo, hi, data, at in T.slices(batch.column(0), SLICE):
                _, _, first, (h,) = T.words(data, at, T.LOWER)
                v, w, row = _sequences(h, first)
                n = np.diff(first)
                if parts > 1:
                    mine = np.flatnonzero(_part_of(v, parts) == part)
                    v, w, row = v[mine], w[mine], row[mine]
                own = v != BEGIN
                key = np.concatenate([pair_key(v, w), v[own]])
                row = np.concatenate([row, row[own]])
                delta, found = table.get(key)
                logp = np.where(n > 0, n * unknown + ends, 0) + np.bincount(row, delta, hi - lo).astype(np.int64)
                none = [pa.nulls(hi - lo, t) for t in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*[batch.column(k)[lo:hi] for k in range(1, batch.num_columns)], pa.array(n), pa.array(logp), *none], names)
                if some is not None:
                    low = (key & _U(FILTER_BITS - 1)).astype(np.int64)
                    maybe = np.flatnonzero(~found & ((some[low >> 5] >> (low & 31).astype(np.uint32)) & 1 == 1))
                    yield _asked(_shard_of(key[maybe], shards), key[maybe], row[maybe].astype(np.int32), batch.column(batch.num_columns - 1)[lo].as_py())

    def _asked(shard: np.ndarray, key: np.ndarray, row: np.ndarray, rid: int) -> pa.RecordBatch:
        """A row for each shard: the number of the slice's first document, and for each key asked of the shard the key and the document."""
        order = np.lexsort((row, shard))
        shard, key, row = shard[order], key[order], row[order]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(shard) else np.zeros(1, np.int64)
        own = [[f(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x, f in ((key, lambda y: y.tobytes()), (row, lambda y: zlib.compress(np.diff(y, prepend=0).astype("<i4").tobytes(), 1)))]
        m = len(cuts) - 1
        empty = [pa.nulls(m, schema[c]) for c in extra]
        numbers = [pa.array(np.full(m, rid)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(shard[cuts[:-1]].astype(np.int32))]
        return pa.RecordBatch.from_arrays([*empty, *numbers, pa.array(own[0], pa.binary()), pa.array(own[1], pa.binary())], names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, delta = batch.column(0).to_numpy().view(_U), batch.column(1).to_numpy().astype("<i4")
            shard = _shard_of(key, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)) if len(shard) else np.zeros(1, np.int64)
            parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[p[0]]) for p in parts], pa.int32()), pa.array([key[p].tobytes() for p in parts], pa.binary()), pa.array([delta[p].tobytes() for p in parts], pa.binary())], ["shard", "keys", "rows"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row that asks, the sums of deltas of its documents, from rows (shard, rid, keys, rows) sorted by shard, those of the model, without rid, first."""
        at, table, parts = -1, None, []
        for batch in batches:
            out: list[tuple] = []
            for shard, rid, keys_, rows_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    at, table, parts = shard, None, []
                if rid is None:
                    parts.append((np.frombuffer(keys_, "<u8").astype(_U), np.frombuffer(rows_, "<i4")))
                    continue
                if table is None:
                    table = Lookup(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else Lookup(np.zeros(0, _U), np.zeros(0, np.int32))
                    parts = []
                delta, _ = table.get(np.frombuffer(keys_, "<u8").astype(_U))
                row = np.cumsum(np.frombuffer(zlib.decompress(rows_), "<i4").astype(np.int64))
                total = np.bincount(row, delta).astype(np.int64)
                some = np.flatnonzero(total)
                if len(some):
                    out.append((rid, _squeezed(np.diff(some, prepend=0)), _squeezed(total[some])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["_rid", "rows", "sums"])

    from pyspark.sql.pandas.types import to_arrow_schema

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [*extra, "_rid", "n_words", "logp", "shard", "keys", "rows"]
    schema = {f.name: f.type for f in to_arrow_schema(docs.select(*extra).schema)}
    out = ", ".join([*[f"`{c}` {types[c]}" for c in extra], "_rid long, n_words long, logp long, shard int, keys binary, rows binary"])
    scored = docs.select("text", *extra, F.monotonically_increasing_id().alias("_rid")).mapInArrow(run, out)
    scored = shared.freed(scored, "lm-scores")
    sums = scored.where("shard is null").drop("shard", "keys", "rows")
    if tail is not None:
        asks = scored.where("shard is not null").select("shard", "_rid", "keys", "rows")
        known = tail.mapInArrow(packed, "shard int, keys binary, rows binary").select("shard", F.lit(None).cast("long").alias("_rid"), "keys", "rows")
        met = known.unionByName(asks).repartition(shards, "shard").sortWithinPartitions("shard", F.col("_rid").asc_nulls_first())
        answers = met.mapInArrow(answered, "_rid long, rows binary, sums binary")
        more = answers.repartition("_rid").sortWithinPartitions("_rid").mapInArrow(_added, "_rid long, more long")
        sums = sums.join(more.hint("merge"), "_rid", "left").withColumn("logp", F.col("logp") + F.coalesce("more", F.lit(0))).drop("more")
    sums = sums.drop("_rid")
    sums = shared.freed(sums if part == 0 else sums.groupBy(*extra).agg(F.max("logp").alias("logp")), "lm-part-sums")
    shared.removed(table_, scored)
    sent.destroy()
    return sums


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, sum) of each document from rows (rid of a slice's first document, steps between documents, sums), sorted by the first."""

    def rows(first: int, parts: list[tuple]) -> pa.RecordBatch:
        row, more = (np.concatenate(x) for x in zip(*parts, strict=True))
        total = np.zeros(row.max() + 1, np.int64)
        np.add.at(total, row, more)
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(some + first), pa.array(total[some])], ["_rid", "more"])

    at, parts = None, []
    for batch in batches:
        for first, row, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first != at and parts:
                yield rows(at, parts)
                parts = []
            at = first
            parts.append((np.cumsum(_unsqueezed(row)), _unsqueezed(more)))
    if parts:
        yield rows(at, parts)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([x.to_numpy().tobytes()], pa.binary()) for x in batch.columns], ["k", "d"])


def classify(docs: DataFrame, trusted: DataFrame, keep: float = KEEP, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int | None = None) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, kept) of every row of docs.

    threshold is the perplexity, in steps of a 256th of a doubling, up to which `keep` of the language's documents with words lie; documents
    above it aren't kept. A null language is one of its own. Null texts and texts without words have no perplexity and aren't kept; a language
    without any other has no threshold. Rows that repeat an id are scored each. Without trusted text nothing is judged: perplexity and threshold are
    null and all documents with words stay. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(trusted, head, text_col, parts)
    if model is None:
        n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        none = F.lit(None).cast("double")
        return rows.select("doc_id", "lang", n.alias("n_words"), none.alias("perplexity"), none.alias("threshold"), (n > 0).alias("kept"))
    scored = log_probabilities(rows, model, head, ("doc_id", "lang"), spend=True)
    nats = -F.col("logp") / float(UNIT) / (F.col("n_words") + 1)
    scored = scored.withColumn("step", F.when(F.col("n_words") > 0, F.ceil(nats / math.log(2) * 256)))
    steps = scored.where("step is not null").groupBy("lang", "step").agg(F.count("*").alias("n"))
    # A row a language and step: a few thousand steps a language, however many documents.
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    cuts = steps.where(F.col("upto") >= F.lit(keep) * F.col("all")).groupBy(F.col("lang").alias("of")).agg(F.min("step").alias("cut"))
    out = scored.join(cuts, F.col("lang").eqNullSafe(F.col("of")), "left")
    return out.select(
        "doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, F.exp(nats)).alias("perplexity"),
        F.pow(F.lit(2.0), F.col("cut") / 256).alias("threshold"), F.coalesce(F.col("step") <= F.col("cut"), F.lit(False)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents that labels call good."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = shared.freed(labels.where("quality > 0").select("doc_id").distinct(), "lm-good")
    # The filter is there so that few texts besides trusted ones are shuffled; the join decides.
    maybe = docs.where(shared.maybe_in(F.col("doc_id"), shared.filter_of(good, F.col("doc_id"))))
    return classify(docs, maybe.join(good.hint("merge"), "doc_id", "left_semi"))
