"""Stretches of units (words or lines) that start earlier too: places of documents, chains of matches, and texts without them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm import text as T

#: The place of rows without an id: after all others.
LAST = (1 << 63) - 1


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, place, tie, text): (place, tie) is the same for rows of one id and text alone, which have the same result."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("place"), F.xxhash64(text).alias("tie"), text.alias("text"))


def units(data: np.ndarray, at: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(start, end, first of each row and one more, two hashes, words in each): words, or lines without blanks around them, empty ones left out."""
    start, end, first, h = T.words(data, at, hashes=2)
    if kind == "words" or not len(start):
        return start, end, first, h, np.ones(len(start), np.int64)
    line = np.r_[0, np.cumsum(data == 10)][start]
    row = T.rows_of(np.arange(len(start)), first)
    opens = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (row[1:] != row[:-1])])
    closes = np.r_[opens[1:], len(start)]
    return start[opens], end[closes - 1], np.searchsorted(opens, first), [T.runs_hashed(x, opens, closes, k) for k, x in enumerate(h)], closes - opens


def chained(matches: DataFrame) -> DataFrame:
    """(place, tie, first, last, ref_place, ref_first): matches (the same columns) that follow each other at one distance from one reference, as one.

    first to last are windows by their first units; last of a window that is longer than others ends where that does.
    """
    w = Window.partitionBy("place", "tie").orderBy("first", "last")
    shift = F.col("ref_first") - F.col("first")
    same = (F.col("ref_place") == F.lag("ref_place").over(w)) & (shift == F.lag(shift).over(w)) & (F.col("first") <= F.lag("last").over(w) + 1)
    runs = matches.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("place", "tie", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("ref_place", "first").alias("ref_place"), F.min("ref_first").alias("ref_first")).drop("_run")


def _kept(kind: str, more: int):
    glue = 32 if kind == "words" else 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            at_span, of_first, of_last = spans.offsets.to_numpy(), *(spans.values.field(k).to_numpy() for k in (0, 1))
            for lo, hi, data, at in T.slices(batch.column(1)):
                start, end, first, _, _ = units(data, at, kind)
                n = np.diff(at_span[lo : hi + 1])
                of = slice(at_span[lo], at_span[hi])
                base = np.repeat(first[:-1], n)
                cover = np.zeros(len(start) + 1, np.int64)
                np.add.at(cover, of_first[of] + base, 1)
                np.add.at(cover, of_last[of] + more + base, -1)
                stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                size = end[stay] - start[stay] + 1
                ends = np.cumsum(size)
                total = int(ends[-1]) if len(ends) else 0
                take = np.repeat(start[stay] - ends + size, size) + np.arange(total)
                out = np.append(data, np.uint8(glue))[take]
                out[ends - 1] = glue
                edge = np.r_[0, ends][np.searchsorted(stay, first)]
                texts = [out[x : max(x, y - 1)].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
                count = np.diff(first)
                kept = np.diff(np.searchsorted(stay, first))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(count), pa.array(count - kept), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode("utf-8", "replace") for t in texts])],
                    ["doc_id", "n_units", "n_removed", "kept_sha256", "kept"],
                )

    return run


def without(texts: DataFrame, runs: DataFrame, kind: str, more: int) -> DataFrame:
    """(doc_id, n_units, n_removed, kept_sha256, kept) of every row of placed texts: without units first to last + more - 1 of its runs."""
    own = runs.groupBy("place", "tie").agg(F.collect_list(F.struct(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))).alias("spans"))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    joined = texts.join(own.hint("merge"), ["place", "tie"], "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    return joined.mapInArrow(_kept(kind, more), "doc_id long, n_units long, n_removed long, kept_sha256 string, kept string")
