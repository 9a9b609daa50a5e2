"""Token ids in ORC: ascending document ids, run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm import shared
from tickloom.llm.text import giving_back, slices, spans_hashed

END_ID = 2
#: Pieces of text whose ids a Python worker remembers at most (some 50 bytes each); beyond, those met once are forgotten.
CACHE = 600_000
#: New pieces that are encoded in one call, and bytes of text that are hashed at once.
AT_ONCE, CHUNK = 1 << 15, 1 << 20
#: Rows between entries of the row index, and bytes of a stripe.
STRIDE, STRIPE = 2_000, 16 << 20

_U = np.uint64
_LETTER, _MARK, _BLANK = (np.zeros(256, bool) for _ in range(3))
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_MARK[[ord(c) for c in ".,;:!?"]] = True
_BLANK[[*range(9, 14), *range(28, 33)]] = True
#: The character that byte-level tokenizers write for each byte: itself where it can be seen, else the next from U+0100 on.
_SEEN = np.zeros(256, bool)
_SEEN[[*range(33, 127), *range(161, 173), *range(174, 256)]] = True
_WRITTEN = np.where(_SEEN, np.arange(256), 255 + np.cumsum(~_SEEN)).astype("<u4")


def _after_ink(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each of the places `at` (all above 0) isn't white space."""
    one, two, three = b[at - 1], b[np.maximum(at - 2, 0)], b[np.maximum(at - 3, 0)]
    # Unicode's White_Space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
    blank = _BLANK[one] | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
    wide = (three == 0xE2) & (two == 0x80) & (((one >= 0x80) & (one <= 0x8A)) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    wide |= ((three == 0xE2) & (two == 0x81) & (one == 0x9F)) | ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    return ~(blank | wide)


def _letters(b: np.ndarray) -> np.ndarray:
    """Whether each byte is an ASCII letter or of a letter from U+00C0 to U+00FF."""
    tail = np.zeros(len(b), bool)
    tail[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] < 0xC0) & (b[1:] != 0x97) & (b[1:] != 0xB7)
    out = _LETTER[b] | tail
    out[:-1] |= tail[1:]
    return out


def pieces(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each piece of the rows b[at[i]:at[i + 1]] starts, first piece of each row and one more).

    Rows are cut only where no token crosses, whatever stands around: before a space or line end that follows ink, before
    a mark that follows a letter, and between a letter and the single line end before it. So pieces can be encoded alone.
    """
    space = np.flatnonzero((b == 32) | (b == 10))
    space = space[space > 0]
    lines = space[b[space] == 10] + 1
    lines = lines[(lines > 1) & (lines < len(b))]
    marks = np.flatnonzero(_MARK[b])
    marks = marks[marks > 0]
    cut = np.zeros(len(b) + 1, bool)
    cut[space[_after_ink(b, space)]] = True
    cut[lines[_LETTER[b[lines]] & _after_ink(b, lines - 1)]] = True
    cut[marks[_LETTER[b[marks - 1]]]] = True
    cut[at] = True
    cut[len(b)] = False
    start = np.flatnonzero(cut)
    return start, np.searchsorted(start, at)


def _end_to_end(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes b[start:end] of each pair, one after another."""
    size = end - start
    return b[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


class Encoder:
    """Ids of texts by the tokenizers library, which gets each different piece once.

    Pieces are known by 64 bits of hash and told apart by 64 more. A text that holds one of the tokenizer's added tokens is one piece, and so is each
    text of a tokenizer that doesn't cut words as byte-level ones do.
    """

    def __init__(self, path: str, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        told = json.loads(self.tokenizer.to_str())
        first = told.get("pre_tokenizer") or {}
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = told["model"]["type"] == "BPE" and told.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        self.cuts = self.cuts and not any(c.isspace() for t in self.added for c in t.decode())
        # Cuts before each space alone, which is all that words of letters need: the library then does without its pattern and its map of bytes.
        told |= {"pre_tokenizer": {"type": "Split", "pattern": {"String": chr(_WRITTEN[32])}, "behavior": "MergedWithNext", "invert": False}, "added_tokens": [], "post_processor": None}
        self.plain = Tokenizer.from_str(json.dumps(told)) if self.cuts else self.tokenizer
        if self.cuts and hasattr(self.plain.model, "_resize_cache"):
            # It gets each word once; what the library would keep of it is never asked for.
            self.plain.model._resize_cache(0)
        # A byte-level vocabulary writes each byte as one character.
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes_of[k] = len(token)
        # By hash, ascending: the number of the piece. By number: second hash, times met, ids at flat[at[n]:at[n + 1]].
        self.keys, self.number = np.zeros(0, _U), np.zeros(0, np.int64)
        self.check, self.met, self.flat, self.at = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, b: np.ndarray, start: np.ndarray, end: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The numbers that new pieces b[start:end] get. Those with a space in front are encoded end to end in one call and told apart by the bytes that ids stand for; those of letters alone in a call of their own."""
        flat, sizes, raw = [], [], b.tobytes()
        other = np.r_[0, np.cumsum(~_letters(b))]
        for lo in range(0, len(start), AT_ONCE):
            first, last = start[lo : lo + AT_ONCE], end[lo : lo + AT_ONCE]
            # A space and letters: no object of its own is made of such a word.
            plain = np.full(len(first), self.cuts) & (last - first > 1) & (other[last] - other[first] == 1)
            plain[plain] = b[first[plain]] == 32
            letters = _end_to_end(b, first[plain], last[plain])
            if any(t in letters.tobytes() for t in self.added):
                plain[plain] = [not any(t in raw[x:y] for t in self.added) for x, y in zip(first[plain].tolist(), last[plain].tolist(), strict=True)]
                letters = _end_to_end(b, first[plain], last[plain])
            written = _WRITTEN[letters].tobytes().decode("utf-32-le")
            left = np.flatnonzero(~plain)
            own = [raw[x:y] for x, y in zip(first[left].tolist(), last[left].tolist(), strict=True)]
            joins = np.full(len(own), self.cuts) & (last[left] > first[left])
            if self.cuts:
                at = left[joins]
                joins[joins] = (b[first[at]] == 32) & _after_ink(b, last[at])
                every = b"\n".join(own)
                if any(t in every for t in self.added):
                    joins &= np.fromiter((not any(t in w for t in self.added) for w in own), bool, len(own))
            joined = b"".join(own[k] for k in np.flatnonzero(joins).tolist())
            try:
                text = joined.decode()
            except UnicodeDecodeError:  # a byte that isn't UTF-8 becomes a character of three
                joins &= np.fromiter(("\ufffd" not in w.decode("utf-8", "replace") for w in own), bool, len(own))
                text = b"".join(own[k] for k in np.flatnonzero(joins).tolist()).decode()
            size, out_of = np.zeros(len(first), np.int64), []
            for tokenizer, every, which in ((self.tokenizer, text, left[joins]), (self.plain, written, np.flatnonzero(plain))):
                ids = np.array(tokenizer.encode_batch_fast([every], add_special_tokens=False)[0].ids if every else [], np.int32)
                size[which] = np.diff(np.r_[0, np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum((last - first)[which])) + 1]) if every else 0
                out_of.append((which, ids))
            rest = [e.ids for e in self.tokenizer.encode_batch_fast([own[k].decode("utf-8", "replace") for k in np.flatnonzero(~joins).tolist()], add_special_tokens=False)]
            size[left[~joins]] = [len(x) for x in rest]
            out = np.empty(int(size.sum()), np.int32)
            for which, ids in (*out_of, (left[~joins], np.fromiter(chain.from_iterable(rest), np.int32))):
                mine = np.zeros(len(size), bool)
                mine[which] = True
                out[np.repeat(mine, size)] = ids
            flat.append(out)
            sizes.append(size)
        before = len(self.check)
        self.flat = np.concatenate([self.flat, *flat])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])
        self.check = np.concatenate([self.check, check])
        self.met = np.concatenate([self.met, np.zeros(len(start), np.int64)])
        return np.arange(before, before + len(start))

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of ascending keys, -1 for new ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.number[at], -1)

    def _numbers(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each piece b[start:end]; new ones are learned."""
        key, check = spans_hashed(b, start, end, 2)
        named = pa.array(key).dictionary_encode()
        which, keys = named.indices.to_numpy(), named.dictionary.to_numpy()
        order = np.argsort(keys)
        keys, rank = keys[order], np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        which = rank[which]
        number = self._known(keys)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            at = np.empty(len(keys), np.int64)
            at[which[::-1]] = np.arange(len(which))[::-1]
            at = at[fresh]
            number[fresh] = self._learn(b, start[at], end[at], check[at])
            into = np.searchsorted(self.keys, keys[fresh])
            self.keys, self.number = np.insert(self.keys, into, keys[fresh]), np.insert(self.number, into, number[fresh])
        number = number[which]
        other = np.flatnonzero(self.check[number] != check)
        if len(other):
            number[other] = self._learn(b, start[other], end[other], check[other])
        return number

    def _forget(self) -> None:
        """Keeps the pieces met more than once; all go where these are too many themselves."""
        stay = self.met > 1
        stay[stay] &= 2 * stay.sum() <= self.most
        size = np.diff(self.at)
        self.flat, self.at = self.flat[np.repeat(stay, size)], np.r_[0, np.cumsum(size[stay])]
        renumbered, mine = np.cumsum(stay) - 1, stay[self.number]
        self.keys, self.number = self.keys[mine], renumbered[self.number[mine]]
        self.check, self.met = self.check[stay], np.ones(int(stay.sum()), np.int64)

    def _pieces(self, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """pieces(), but for rows that only the library itself can cut."""
        start, first = pieces(b, at)
        whole = np.zeros(len(at) - 1, bool) if self.cuts else np.ones(len(at) - 1, bool)
        raw = b.tobytes()
        for token in self.added:
            found = raw.find(token)
            while found >= 0:
                whole[np.searchsorted(at, found, "right") - 1] = True
                found = raw.find(token, found + 1)
        if whole.any():
            row = np.searchsorted(at, start, "right") - 1
            start = start[~whole[row] | (start == at[row])]
            first = np.searchsorted(start, at)
        return start, first

    def encode(self, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with END_ID after each row b[at[i]:at[i + 1]], where each row's ids start and one more)."""
        if len(self.check) > self.most or len(self.flat) > 8 * self.most:
            self._forget()
        start, first = self._pieces(b, at)
        end = np.r_[start[1:], len(b)]
        number, lo = np.empty(len(start), np.int64), 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + CHUNK, "right")))
            number[lo:hi] = self._numbers(b[start[lo] : end[hi - 1]], start[lo:hi] - start[lo], end[lo:hi] - start[lo])
            lo = hi
        self.met += np.bincount(number, minlength=len(self.met))
        n = self.at[number + 1] - self.at[number]
        ends = np.r_[0, np.cumsum(n)]
        to = ends[first] + np.arange(len(at))
        result = np.full(int(to[-1]), END_ID, np.int32)
        body = np.ones(len(result), bool)
        body[to[1:] - 1] = False
        result[body] = self.flat[np.repeat(self.at[number] - ends[:-1], n) + np.arange(ends[-1])]
        return result, to


_encoders: dict[str, Encoder] = {}


_SCHEMA = "part int, row long, doc_id long, n_tokens long, ids array<int>"


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoders.setdefault(path, None) or Encoder(path)
        _encoders[path] = e
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi, data, rows in slices(texts, CHUNK):
                ids, at = e.encode(data, rows)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                where = pa.array(np.full(hi - lo, part, np.int32)), pa.array(np.arange(row, row + hi - lo))
                yield pa.RecordBatch.from_arrays([*where, batch.column(0)[lo:hi], pa.array(np.diff(at)), lists], ["part", "row", "doc_id", "n_tokens", "ids"])
                row += hi - lo

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", stripe: int = STRIPE, stride: int = STRIDE) -> None:
    """Writes part, row, doc_id, n_tokens and ids of every row of docs to ORC files under `path`, in ascending doc_id order over the files.

    A null text is empty and has the end id alone; rows with a null id come first; rows that repeat an id stand side by side, in the
    order of a hash of their texts. (part, row) is a row's place in that order. An empty table gives a file without rows. Each range of ids is a
    file of its own, so stripes are read in parallel, and a search for an id skips files, stripes and row groups by their
    statistics and Bloom filters.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("_tie"))
    # Texts are shuffled rather than ids: they are smaller.
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    out = ordered.mapInArrow(giving_back(_encoded(tokenizer)), _SCHEMA)
    out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.row.index.stride", str(stride)).option("orc.stripe.size", str(stripe)).option("orc.compress", "ZSTD").orc(path)


def read_tokens(spark: SparkSession, path: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """part, row, doc_id, n_tokens, ids; of the ids from `least` to `most` alone where these are given: files, stripes and row groups without any are skipped."""
    rows = spark.read.schema(_SCHEMA).orc(path)
    rows = rows if least is None else rows.where(F.col("doc_id") >= least)
    return rows if most is None else rows.where(F.col("doc_id") <= most)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        at = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "row", "doc_id", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of the files: start counts the ids of all rows before it.

    Parts follow each other by their numbers, rows by theirs; only one sum a part is added up across parts.
    """
    tokens = read_tokens(spark, path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    rows = tokens.select("part", "row", "doc_id", "ids").mapInArrow(_summed, "part int, row long, doc_id long, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(parts, "part").withColumn("start", F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    at = shared.path(spark, "tokens")
    write_tokens(docs, at, tokenizer)
    return token_index(spark, at)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
