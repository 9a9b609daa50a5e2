"""Substring dedup by relative Lempel-Ziv parsing: documents are factored against an index of reference blocks.

1. Texts are cut into content-defined blocks: each window of WINDOW words picks the smallest hash among its runs of RUN words, consecutive windows with
   the same pick are a block. Equal stretches are cut alike except at their ends. The index holds each different block once, as a reference: where it
   stands first.
2. A document's blocks that are in the index with an earlier reference are copied as wholes. Blocks next to them differ from any reference as wholes, but may begin
   or end alike: where their pick is shared, each of their windows is looked up, which tells at what word a factor ends.
3. The parse goes greedily from left to right: a factor goes on as long as the next block or window has the same reference at the same distance.
   Factors of WINDOW words and more are the duplicate spans. No window is missed: one that starts earlier lies there in a block with the same pick.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import shared, spans
from tickloom.llm import text as T

#: Words of the shortest duplicate span; words in the runs that blocks are cut by.
WINDOW, RUN = 20, 4


def blocks(h: np.ndarray, first: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, hash of the pick) of each block; windows go by their first word among those of all rows."""
    none = np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    window = np.flatnonzero(left >= n)
    if not len(window):
        return none, none, none, none.astype(np.uint64)
    g = T.windows_hashed(h, k)
    pick = np.lib.stride_tricks.sliding_window_view(g, n - k + 1).argmin(1)[window] + window
    row = T.rows_of(window, first)
    opens = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])])
    return row[opens], window[opens], window[np.r_[opens[1:], len(window)] - 1], g[pick[opens]]


def _cut(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, at in T.slices(batch.column(2)):
                _, _, first, h, _ = spans.units(data, at, "words")
                row, a, b, pick = blocks(h[0], first, n, k)
                whole = T.runs_hashed(h[1], a, b + n, 1)
                own = pa.array(row + lo)
                inside = (x - first[row] for x in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(pick)), pa.array(T.signed(whole)), batch.column(0).take(own), batch.column(1).take(own), *(pa.array(x.astype(np.int32)) for x in inside)], ["pick", "block", "place", "tie", "first", "last"])

    return run


def _windows(n: int):
    """Both hashes of each window in the stretches that `open` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            at_open, of_first, of_last = wanted.offsets.to_numpy(), *(wanted.values.field(k).to_numpy() for k in (0, 1))
            for lo, hi, data, at in T.slices(batch.column(2)):
                _, _, first, h, _ = spans.units(data, at, "words")
                of = slice(at_open[lo], at_open[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(at_open[lo : hi + 1]))
                size = of_last[of] - of_first[of] + 1
                ends = np.cumsum(size)
                w = np.repeat(of_first[of] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
                row = np.repeat(row, size)
                w1, w2 = (T.windows_hashed(h[k], n, k)[w + first[row]] if len(w) else np.zeros(0, np.uint64) for k in (0, 1))
                own = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(w1)), pa.array(T.signed(w2)), batch.column(0).take(own), batch.column(1).take(own), pa.array(w.astype(np.int32))], ["w1", "w2", "place", "tie", "first"])

    return run


def _factors(texts: DataFrame, n: int, k: int) -> DataFrame:
    cut = texts.select("place", "tie", "text").mapInArrow(_cut(n, k), "pick long, block long, place long, tie long, first int, last int")
    # Picks that stand once are most; they go before anything else is matched.
    picks = shared.written(cut.groupBy("pick").agg(F.count("*").alias("n"), (F.min("block") != F.max("block")).alias("many")).where("n > 1"), "picks")
    met = shared.written(shared.spread_join(cut, picks.select("pick", "many"), ["pick"], picks, ["place", "first"]), "blocks")
    here = F.struct(F.col("place"), F.col("first"))
    index = shared.written(met.groupBy("pick", "block").agg(F.min(here).alias("ref"), F.count("*").alias("n")).where("n > 1"), "block-index")
    known = shared.spread_join(met, index.drop("n"), ["pick", "block"], index, ["place", "first"], "left")
    known = known.select("place", "tie", "first", "last", F.when(F.col("ref") < here, F.col("ref")).alias("ref"), "many")
    known = shared.written(known.where("ref is not null or many"), "block-states")
    copied = known.where("ref is not null").select("place", "tie", "first", "last", F.col("ref.place").alias("ref_place"), F.col("ref.first").alias("ref_first"))

    edges = known.where("ref is null").groupBy("place", "tie").agg(F.collect_list(F.struct("first", "last")).alias("open"))
    single = texts.select("place", "tie", "text").join(edges.hint("merge"), ["place", "tie"]).mapInArrow(_windows(n), "w1 long, w2 long, place long, tie long, first int")
    single = shared.written(single, "open-windows")
    earliest = shared.written(single.groupBy("w1", "w2").agg(F.min(here).alias("ref"), F.count("*").alias("n")).where("n > 1"), "window-index")
    found = shared.spread_join(single, earliest.drop("n"), ["w1", "w2"], earliest, ["place", "first"]).where(F.col("ref") < here)
    found = found.select("place", "tie", "first", F.col("first").alias("last"), F.col("ref.place").alias("ref_place"), F.col("ref.first").alias("ref_first"))
    return spans.chained(copied.unionByName(found))


def factors(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, tie, start, n_words, ref_place, ref_start): each document's factors of `window` words and more, in words.

    place is the document's id, or spans.LAST where it is null, and tie a hash of its text. Words start to start + n_words - 1 are
    those of the document ref_place from ref_start on, which is an earlier place; factors of unlike references may overlap by
    less than a window.
    """
    f = _factors(spans.placed(docs, id_col, text_col), window, min(RUN, window))
    return f.select("place", "tie", F.col("first").alias("start"), (F.col("last") - F.col("first") + window).alias("n_words"), "ref_place", F.col("ref_first").alias("ref_start"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of docs: without the words that a window of `window` words covers which starts earlier too.

    Earlier is in a smaller id, or in the same document further up. Windows are judged on the input. Null texts have no words. Rows that
    repeat an id count as one document: what starts further up in one of them is earlier than in the others. Rows without an id come after all
    others and count as one document too. An empty table gives an empty result. Other columns are not read.
    """
    texts = spans.placed(docs, id_col, text_col)
    return spans.without(texts, _factors(texts, window, min(RUN, window)), "words", window).withColumnRenamed("n_units", "n_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, unnest([array_to_string(w[i:i + 19], ' ') FOR i IN range(1, len(w) - 18)]) AS g FROM w WHERE len(w) >= 20
), r AS MATERIALIZED (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM v) WHERE n > 1
), u AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w
), c AS (
  SELECT DISTINCT doc_id, p + unnest(range(0, 20)) AS p FROM r
), k AS (
  SELECT u.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY u.p) AS t FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.p = c.p GROUP BY 1
)
SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
