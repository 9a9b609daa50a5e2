"""Benchmark decontamination by templates: numbers, units and names become typed slots, windows are joined, slots must agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import shared
from tickloom.llm import text as T

#: Tokens in a window, and how many of them must be plain words for a match up to slots; a shorter item is one window of all its tokens.
WINDOW, LITERALS = 10, 5
#: Items of fewer words are short.
SHORT = 5
#: Bits of the filter that documents' windows pass before the join.
FILTER_BITS = 1 << 23

#: Words that are numbers, and words that are units after a number (fixed values).
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons lb lbs pound pounds ounce ounces ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres mph kmh".split()


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(T.words(data, np.array([0, len(data)]), T.PLAIN)[3][0][0])


_NUMBERS = np.array(sorted(map(_hash_of, NUMBER_WORDS)), np.uint64)
_UNITS = np.array(sorted(map(_hash_of, UNITS)), np.uint64)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:\n"]] = True
#: Between parts of a number in digits, and between number words.
_MARKS, _JOINTS = np.frombuffer(b".,/", np.uint8), np.frombuffer(b" -", np.uint8)


def templates(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """(first token of each row and one more, two hashes of each token or of its slot's type, whether it is a slot, two hashes of its own).

    A number starts with a digit or is a number word; a unit is a unit word after a number; a name is a capitalised
    word, or one of capitals, that doesn't open a sentence. All else is itself in lower case (of ASCII and of Latin-1's letters). What is written in
    parts is one token: numbers with a mark between them alone ("1,000", "3.5", "7/8"), number words with a space or hyphen ("twenty five"), names with a space ("Anna Maria").
    """
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    start, end, first, h = T.words(data + accented.astype(np.uint8) * np.uint8(32), at, T.PLAIN, 2)
    if not len(start):
        return first, h, np.zeros(0, bool), h
    c0 = data[start]
    large = (data >= 65) & (data <= 90) | accented
    wide = c0 == 0xC3
    second = np.minimum(start + 1 + wide, len(data) - 1)
    second = np.minimum(second + (data[second] == 0xC3), len(data) - 1)
    capital = large[np.minimum(start + wide, len(data) - 1)] & (second < end)
    ended = np.r_[0, np.cumsum(_ENDS[data])]
    opens = np.r_[True, ended[start[1:]] > ended[end[:-1]]]
    begins = np.zeros(len(start), bool)
    begins[first[:-1][first[:-1] < len(start)]] = True
    opens |= begins
    digits = (c0 >= 48) & (c0 <= 57)
    number = digits | np.isin(h[0], _NUMBERS)
    unit = np.r_[False, number[:-1]] & ~begins & np.isin(h[0], _UNITS)
    name = capital & ~opens & ~number & ~unit
    # Parts of one number or name.
    between = np.zeros(len(start), np.uint8)
    close = np.r_[False, start[1:] - end[:-1] == 1] & ~begins
    between[close] = data[start[close] - 1]
    both = lambda x: x & np.r_[False, x[:-1]]
    joins = both(digits) & np.isin(between, _MARKS) | both(number & ~digits) & np.isin(between, _JOINTS) | both(name) & (between == 32)
    lo = np.flatnonzero(~joins)
    hi = np.r_[lo[1:], len(start)]
    own = [x[lo] for x in h]
    long = np.flatnonzero(hi - lo > 1)
    for k in (0, 1):
        own[k][long] = T.runs_hashed(h[k], lo[long], hi[long], k)
    slot = (number | unit | name)[lo]
    kind = (number * 1 + unit * 2 + name * 3)[lo].astype(np.uint64)
    return np.searchsorted(lo, first), [np.where(slot, kind, x) for x in own], slot, own


def _windows(column: pa.Array, lengths: list[int], literals: int, items: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple, int]]:
    """(first row, first tokens, position, hash, second hash, slots, n) of all windows, for each length n.

    First by their tokens as they are, whatever they hold, without slots; of items, those that templates don't find alike wherever they stand: with
    fewer than `literals` plain words, or alone in their item. Then those with `literals` plain words by their templates.
    """
    for lo, _, data, at in T.slices(column):
        first, t, slot, own = templates(data, at)
        plain = np.r_[0, np.cumsum(~slot)]
        for n in lengths:
            h, pos = T.grams(own[0], first, n)
            h2, _ = T.grams(own[1], first, n, 1)
            ok = (plain[pos + n] - plain[pos] < literals) | (np.diff(first)[T.rows_of(pos, first)] == n) if items else np.ones(len(pos), bool)
            yield lo, first, pos[ok], h[ok], h2[ok], (np.zeros(len(slot), bool), own[0]), n
            if n < literals:
                continue
            h, pos = T.grams(t[0], first, n)
            h2, _ = T.grams(t[1], first, n, 1)
            ok = plain[pos + n] - plain[pos] >= literals
            yield lo, first, pos[ok], h[ok], h2[ok], (slot, own[0]), n


_OUT = "hash long, check long, id long, pos long, slots array<long>"
_NAMES = ["hash", "check", "id", "pos", "slots"]


def _rows(ids: pa.Array, lo: int, first: np.ndarray, pos: np.ndarray, h: np.ndarray, h2: np.ndarray, slots: tuple, n: int) -> pa.RecordBatch:
    slot, own = slots
    each = np.concatenate([np.flatnonzero(slot[p : p + n]) + p for p in pos]) if len(pos) else np.zeros(0, np.int64)
    sizes = np.add.accumulate(np.r_[0, slot])
    at = np.r_[0, np.cumsum(sizes[pos + n] - sizes[pos])] if len(pos) else np.zeros(1, np.int64)
    row = T.rows_of(pos, first)
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(T.signed(own[each])))
    return pa.RecordBatch.from_arrays([pa.array(T.signed(h)), pa.array(T.signed(h2)), ids.take(pa.array(row + lo)), pa.array(pos - first[row]), lists], _NAMES)


def _all_windows(n: int, literals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, first, pos, h, h2, slots, k in _windows(batch.column(1), range(1, n + 1), literals, True):
                # Items take windows of n, or one of all they have if that is less.
                size = np.diff(first)[T.rows_of(pos, first)]
                ok = (size >= n) if k == n else (size == k)
                yield _rows(batch.column(0), lo, first, pos[ok], h[ok], h2[ok], slots, k).append_column("n", pa.array(np.full(int(ok.sum()), k)))

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_exact, item_windows, short): documents that hold windows of a benchmark item up to its slots.

    Windows match when their tokens are equal, or when they have plain words enough and their templates are equal. Those of one document
    and item that stand at the same distance must fill slots alike: each value of the item by one value in the document, and the other way
    round; else only those with the item's own values are counted. n_exact counts windows with the item's own values. An item of
    fewer tokens than a window needs plain words matches as it is, or not at all. One of fewer than SHORT words is flagged as short: so common a phrase may be no sign of the benchmark. Null and empty texts match nothing. Rows that repeat an id are taken as one. Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    # literals: fewer let windows of values alone match; more lose re-parameterised windows of many values. Verbatim ones are found either way.
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text"))
    theirs = items.mapInArrow(_all_windows(window, min(literals, window)), _OUT + ", n long").select("hash", "check", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "n")
    # A bit for each window, at most FILTER_BITS in all however large the benchmark is.
    bit = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = theirs.groupBy(F.floor(bit / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int"))).alias("bits"), F.collect_set("n").alias("ns")).toPandas()
    table = np.zeros(FILTER_BITS // 32, np.int64)
    table[words.w.to_numpy(np.int64)] = words.bits.to_numpy(np.int64)
    lengths = sorted({int(n) for ns in words.ns for n in ns})
    sent = spark.sparkContext.broadcast(np.unpackbits(table.astype("<u4").view(np.uint8), bitorder="little"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for lo, first, pos, h, h2, slots, k in _windows(batch.column(1), lengths, min(literals, window), False):
                ok = bits[(h & np.uint64(FILTER_BITS - 1)).astype(np.int64)] == 1
                if ok.any():
                    yield _rows(batch.column(0), lo, first, pos[ok], h[ok], h2[ok], slots, k)

    # Few of all windows are hits; written, they are counted and joined from one pass over the texts.
    ours = shared.written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(hits, _OUT).withColumnRenamed("id", "doc_id"), "window-hits")
    sizes_of = shared.written(ours.groupBy("hash", "check").agg(F.count("*").alias("n")), "window-counts")
    # A template of many items is as many rows, never one array.
    met = shared.spread_join(ours, theirs.drop("n"), ["hash", "check"], sizes_of, ["doc_id", "pos"]).select("doc_id", "pos", "slots", "item_id", "item_pos", "item_slots")
    pairs = F.arrays_zip("item_slots", "slots")
    lines = met.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"), F.count_distinct("item_pos").alias("n"), F.count_distinct(F.when(F.col("slots") == F.col("item_slots"), F.col("item_pos"))).alias("exact")
    )
    alike = (F.size("pairs") == F.size(F.array_distinct(F.col("pairs.item_slots")))) & (F.size("pairs") == F.size(F.array_distinct(F.col("pairs.slots"))))
    lines = lines.withColumn("n", F.when(alike, F.col("n")).otherwise(F.col("exact"))).where("n > 0")
    found = lines.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_windows"), F.sum("exact").alias("n_exact"))
    sizes = theirs.groupBy("item_id").agg(F.count_distinct("item_pos").alias("item_windows"))
    brief = items.groupBy(F.col("id").alias("item_id")).agg((F.max(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))) < SHORT).alias("short"))
    return found.join(sizes, "item_id").join(brief, "item_id").select("doc_id", "item_id", "n_windows", "n_exact", "item_windows", "short")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
