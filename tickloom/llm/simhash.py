"""SimHash near copies: fingerprints of word shingles, and BK-trees of fingerprints that may be near.

Fingerprints within `radius` bits agree in all but `radius` of some blocks of bits; each choice of blocks that agree is a route, and fingerprints that agree on a route are
a shard, or several where there are more than SHARD. Each shard is a BK-tree: a child hangs at its distance to the parent, a search follows the edges within the radius.
Trees go to the tasks that hold their queries, by a shuffle: all trees together grow with the corpus, so they aren't sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import graph, shared

#: Words in a shingle, bits in which linked fingerprints may differ, seed of the hash.
SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a shard, about. A larger route value is dealt to several shards.
SHARD = 1_024
#: Hashes whose bits are counted at once.
_CHUNK = 1 << 14
_ALL = (1 << 64) - 1


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if more than half of the hashes of the text's shingles, repeats included, have it; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.dtype("<u8"), max(1, len(words) - n + 1))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[lo : lo + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_signed(fingerprint(t or b"", n)) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Tree:
    """A BK-tree of numbers with labels. Each node knows the one label of all below it, or that there are several."""

    def __init__(self) -> None:
        self.fps: list[int] = []
        self.labels: list[int] = []
        self.only: list[int | None] = []
        self.kids: list[dict[int, int]] = []

    def add(self, fp: int, label: int) -> None:
        new = len(self.fps)
        if new:
            at = 0
            while True:
                if self.only[at] != label:
                    self.only[at] = None
                d = (self.fps[at] ^ fp).bit_count()
                down = self.kids[at].setdefault(d, new)
                if down == new:
                    break
                at = down
        self.fps.append(fp)
        self.labels.append(label)
        self.only.append(label)
        self.kids.append({})

    def near(self, fp: int, radius: int, label: int | None = None) -> Iterator[int]:
        """Nodes within radius of fp; subtrees of `label` alone are left out."""
        todo = [0] if self.fps else []
        while todo:
            at = todo.pop()
            if label is not None and self.only[at] == label:
                continue
            d = (self.fps[at] ^ fp).bit_count()
            if d <= radius:
                yield at
            kids = self.kids[at]
            if kids:
                todo += [kids[e] for e in range(max(d - radius, 0), d + radius + 1) if e in kids]


def _root(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def forest(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Links between fps, fewer than there are fps, with the components that all links within radius have."""
    tree, up, out = Tree(), list(range(len(fps))), []
    for i, fp in enumerate(fps):
        for j in tree.near(fp, radius):
            a, b = _root(up, i), _root(up, j)
            if a != b:
                up[a] = b
                out.append((fp, fps[j]))
        tree.add(fp, i)
    return out


def across(fps: list[int], labels: list[int], asks: list[int], ask_labels: list[int], radius: int) -> list[tuple[int, int]]:
    """Links from asks to fps of other labels; of several to fps of one label the first."""
    tree, out = Tree(), []
    for fp, label in zip(fps, labels, strict=True):
        tree.add(fp, label)
    for fp, label in zip(asks, ask_labels, strict=True):
        met = {label}
        for j in tree.near(fp, radius, label):
            if tree.labels[j] not in met:
                met.add(tree.labels[j])
                out.append((fp, fps[j]))
    return out


def _table(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_signed(x[k]) for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def routes(size: int, radius: int = RADIUS, shard: int = SHARD) -> list[int]:
    """Masks of bits: fingerprints within radius agree under at least one. The more fingerprints, the more bits a mask has, so that few agree by chance."""
    blocks = radius + 1
    while blocks < 16 and size > (1 << (64 * (blocks - radius) // blocks)) * shard // 4:
        blocks += 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    masks = [sum(parts[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    assert len(masks) == comb(blocks, radius)
    return masks


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links between numbers within `radius` bits of each other, with the components that all such links have. fps (fp) has each number once.

    First each shard is searched by itself. Where a route value has several shards, the numbers that these links don't yet join to the value's
    largest component then ask all of its shards; subtrees of the asker's own component are left out.
    """
    masks = routes(fps.count(), radius, shard)
    way = F.explode(F.array(*[F.struct(F.lit(k).alias("route"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(masks)]))
    routed = fps.select("fp", way.alias("way")).select("fp", "way.route", "way.value")
    key = ["route", "value"]
    counts = routed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    large = shared.written(counts.where(F.col("n") > shard).select(*key, F.ceil(F.col("n") / shard).cast("int").alias("parts")), "simhash-large")
    several = not large.isEmpty()
    dealt = routed.withColumn("shard", F.lit(0))
    if several:
        # A value's shards differ by route, so what one route parts another joins.
        dealt = routed.join(large, key, "left").withColumn("shard", F.pmod(F.xxhash64("fp", "route"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([x for one in batch.column(0).to_pylist() for x in forest([fp & _ALL for fp in one], radius)])

    shards = dealt.groupBy(*key, "shard").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    found = shared.written(shards.select("fps").mapInArrow(inside, "a long, b long").distinct(), "simhash-links")
    if not several:
        return found
    joined = graph.components(found)
    members = dealt.join(large.select(*key, "parts"), key).join(joined, F.col("fp") == F.col("node"), "left").select(*key, "shard", "fp", F.coalesce("component", "fp").alias("label"))
    members = shared.written(members, "simhash-members")
    most = members.groupBy(*key, "label").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("own"))
    most = shared.written(most.where("n > own").select(*key, "main", F.ceil((F.col("n") - F.col("own")) / shard).cast("int").alias("chunks")), "simhash-main")
    asking = members.join(most, key).where("label <> main").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    packed = lambda a, b: [F.collect_list("fp").alias(a), F.collect_list("label").alias(b)]
    asks = asking.groupBy(*key, "chunk").agg(*packed("asks", "ask_labels")).drop("chunk")
    trees = members.join(most.select(*key), key, "left_semi").groupBy(*key, "shard").agg(*packed("fps", "labels")).drop("shard")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, c, d in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                yield _table(across([x & _ALL for x in a], b, [x & _ALL for x in c], d, radius))

    tiles = trees.join(asks, key).select("fps", "labels", "asks", "ask_labels").repartition(F.xxhash64("fps", "asks"))
    return found.unionByName(shared.written(tiles.mapInArrow(between, "a long, b long").distinct(), "simhash-links"))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Texts whose fingerprints differ in at most `radius` bits are linked; component_id is the smallest id that links lead to, itself included. A null text is
    one without words: its fingerprint is 0 and linked like any other. Rows without an id are linked too and have the smallest id of their component, null if it has none; rows that repeat
    an id have a row each. An empty table gives an empty result. Other columns aren't read.
    """
    rows = shared.written(fingerprints(docs, id_col, text_col, n), "simhash-rows")
    fps = shared.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-fps")
    labels = graph.components(links(fps.select("fp"), radius, shard))
    named = fps.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("label"))
    # A component's smallest id: a minimum is taken before the shuffle, and labels of many members are dealt out.
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    least = shared.written(least, "simhash-least")
    named = shared.spread_join(named.select("fp", "label"), least.select("label", "component_id"), ["label"], least.select("label", "n"), ["fp"])
    out = shared.spread_join(rows, named.select("fp", "component_id"), ["fp"], fps.select("fp", "n"), ["doc_id"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(spark.read.parquet(f"{sf_dir}/documents.parquet"))
