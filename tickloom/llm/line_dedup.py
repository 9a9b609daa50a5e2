"""Line dedup by winnowing: fingerprints of lines are joined by position, matches are extended both ways, later repeated runs are deleted.

1. A window is the shortest run of lines from one on that has WORDS words; a text of fewer words is one window. The smallest line hash of each window is a
   fingerprint. Two places that share a run of a window or more have equal windows in it, so they have a fingerprint in common: the guarantee of winnowing.
2. Fingerprints that stand at more than one position are joined. At each position the match is extended up and down over all windows that chose
   this fingerprint: those that stand earlier too, at a position of the same fingerprint, are matched.
3. Matches that go on at the same distance from the same earlier lines are one run; runs are deleted where they stand later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import shared, spans
from tickloom.llm import text as T

#: Words of the shortest run of lines that is deleted. One line is enough if it has so many.
WORDS = 10


def windows(words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, last line) of each window, from the numbers of words of all lines and the first line of each row."""
    upto = np.cumsum(words)
    before = upto - words
    last = np.searchsorted(upto, before + least)
    end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(last < end)
    row = np.flatnonzero(np.diff(first))
    short = first[row][upto[first[row + 1] - 1] - before[first[row]] < least]
    at = np.sort(np.r_[at, short])
    return at, np.minimum(last[at], end[at] - 1)


def _positions(least: int):
    """Each fingerprint's position, and the windows that chose it: first and last lines and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, at in T.slices(batch.column(2)):
                _, _, first, h, words = spans.units(data, at, "lines")
                a, b = windows(words, first, least)
                if not len(a):
                    continue
                order = np.argsort(h[0], kind="stable")
                rank = np.zeros(len(order) + 1, np.int64)
                rank[order] = np.arange(len(order))
                # The line of the smallest hash of each window, the first of equal ones.
                chosen = order[np.minimum.reduceat(rank, np.c_[a, b + 1].ravel())[::2]]
                row = T.rows_of(a, first)
                opens = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
                to = pa.array(np.r_[opens, len(a)].astype(np.int32))
                own = pa.array(row[opens] + lo)
                each = [pa.ListArray.from_arrays(to, pa.array(x)) for x in ((a - first[row]).astype(np.int32), (b - first[row]).astype(np.int32), *(T.signed(T.runs_hashed(h[k], a, b + 1, k)) for k in (0, 1)))]
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(h[0][chosen[opens]])), batch.column(0).take(own), batch.column(1).take(own), *each], ["print", "place", "tie", "first", "last", "w1", "w2"])

    return run


def _runs(texts: DataFrame, least: int) -> DataFrame:
    positions = texts.select("place", "tie", "text").mapInArrow(_positions(least), "print long, place long, tie long, first array<int>, last array<int>, w1 array<long>, w2 array<long>")
    positions = shared.written(positions, "fingerprints")
    prints = shared.written(positions.groupBy("print").agg(F.count("*").alias("n")).where("n > 1"), "shared-fingerprints")
    met = shared.spread_join(positions, prints.drop("n"), ["print"], prints, ["place", "tie", "first"])
    single = shared.written(met.select("place", "tie", F.inline(F.arrays_zip("first", "last", "w1", "w2"))), "line-windows")
    here = F.struct(F.col("place"), F.col("first"))
    earliest = shared.written(single.groupBy("w1", "w2").agg(F.min(here).alias("ref"), F.count("*").alias("n")).where("n > 1"), "earliest-windows")
    found = shared.spread_join(single, earliest.drop("n"), ["w1", "w2"], earliest, ["place", "first"]).where(F.col("ref") < here)
    return spans.chained(found.select("place", "tie", "first", "last", F.col("ref.place").alias("ref_place"), F.col("ref.first").alias("ref_first")))


def repeated_runs(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, tie, first, last, ref_place, ref_first): each run of lines (counted from 0) that stands earlier too, and where; place and tie as in substring_dedup.factors."""
    return _runs(spans.placed(docs, id_col, text_col), words)


def line_dedup(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256, kept) of every row of docs: without lines in a run of `words` words and more that starts earlier too.

    Lines are compared without blanks around them and with one blank for each run of them inside; lines of blanks alone don't
    count and aren't kept. A text of fewer words is removed if the same lines are the whole of an earlier text. Earlier is in a smaller id, or in the same document further up; runs
    are judged on the input. Null texts have no lines. Rows that repeat an id count as one document, and so do rows without an id, which come after all
    others. An empty table gives an empty result. Other columns are not read.
    """
    texts = spans.placed(docs, id_col, text_col)
    return spans.without(texts, _runs(texts, words), "lines", 1).withColumnRenamed("n_units", "n_lines")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


SQL = r"""
WITH l AS (
  SELECT doc_id, list_filter([trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) FOR x IN string_split(coalesce(text, ''), chr(10))], lambda x: x <> '') AS w FROM documents
), n AS (
  SELECT doc_id, w, [regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g') FOR x IN w] AS s, [len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) FOR x IN w] AS c FROM l WHERE len(w) > 0
), p AS (
  SELECT *, unnest(range(1, len(w) + 1)) AS p FROM n
), q AS (
  SELECT doc_id, s, p, CASE WHEN list_sum(c) < 10 THEN CASE WHEN p = 1 THEN len(w) END
    ELSE list_filter(range(p, least(p + 10, len(w) + 1)), lambda j: list_sum(c[p:j]) >= 10)[1] END AS q FROM p
), v AS MATERIALIZED (
  SELECT doc_id, p, q, array_to_string(s[p:q], chr(10)) AS g FROM q WHERE q IS NOT NULL
), r AS MATERIALIZED (
  SELECT doc_id, p, q FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM v) WHERE n > 1
), u AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS line FROM l
), c AS (
  SELECT DISTINCT doc_id, unnest(range(p, q + 1)) AS p FROM r
), k AS (
  SELECT u.doc_id, count(*) AS kept, string_agg(line, chr(10) ORDER BY u.p) AS t FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.p = c.p GROUP BY 1
)
SELECT l.doc_id, len(w)::BIGINT AS n_lines, len(w)::BIGINT - coalesce(kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""
