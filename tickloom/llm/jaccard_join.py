"""N-gram Jaccard join: size-banded tiles whose bitmaps bound the overlap before sorted arrays are intersected.

Which documents can meet at all comes from prefix filtering, so tiles hold likely partners only:

1. Every document becomes a set of hashed word n-grams. Equal sets form one class, kept by its smallest id.
2. Two sets that link share one of the first n - ceil(t n) + 1 elements of each, in any order common to all sets. The order puts n-grams
   whose words are rare together first, by a sketch of the words' counts, and those that a sketch of n-grams finds frequent last: neither chance
   nor passages which many documents share often bring two together, so what shares an element doesn't grow with the square of the documents.
3. Where more classes than a tile holds share such an element, each is first compared with the smallest of its size band: a star, so a large group of copies
   becomes one label by as many comparisons as it has members. Pairs of one label need no other comparison.
4. Classes that share an element and whose sizes and bitmaps allow a link are joined to blocks; elements that the same classes share are one group. Groups and blocks that don't fit a tile are dealt to tiles by size band,
   label and a hash; pairs of tiles of the same or neighbouring bands, but for two of one label, are tasks of bounded size.
5. In a pair of tiles, bitmaps bound each overlap from above, and what passes is intersected exactly, unless links found before
   already connect the two. So a group of thousands of copies yields a tree of links, not all pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm import graph, shared
from tickloom.llm import text as T

NGRAM, PERCENT = 4, 85
#: Counters of each sketch, of words and of n-grams; in how many pieces one is summed; sets in a tile.
COUNTERS, PIECES, TILE = 1 << 20, 16, 512
#: Steps of the order of elements in which a count doubles.
STEPS = 8
#: Nodes of rows without an id are from here on.
NO_ID = 1 << 62


def _cut(column: pa.Array, n: int, cost: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """(first row, hashed words, sorted distinct hashed n-grams of each row, sums of `cost` over the words of each): costs only where asked for."""
    for lo, _, data, at in T.slices(column):
        _, _, first, (h,) = T.words(data, at, T.LOWER)
        g, pos = T.grams(h, first, n)
        cut = np.searchsorted(pos, first)
        size = np.diff(first)
        out, costs = [], []
        short = np.flatnonzero((size > 0) & (size < n))
        whole = dict(zip(short, T.runs_hashed(h, first[short], first[short + 1]), strict=True))
        if cost is not None:
            upto = np.r_[0, np.cumsum(cost[(h & np.uint64(COUNTERS - 1)).astype(np.int64)], dtype=np.int64)]
            each = upto[pos + n] - upto[pos]
        for k in range(len(size)):
            if k in whole:
                out.append(np.array([whole[k]], np.uint64))
                costs.append(np.zeros(1, np.int64))
                continue
            v = g[cut[k] : cut[k + 1]]
            order = None if cost is None else np.argsort(v)
            v = np.sort(v) if order is None else v[order]
            new = np.r_[True, v[1:] != v[:-1]] if len(v) else slice(None)
            out.append(v[new])
            if order is not None:
                costs.append(each[cut[k] : cut[k + 1]][order][new])
        yield lo, h, out, costs


def sets(column: pa.Array, n: int = NGRAM) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct hashed n-grams of each row); a text of fewer words is one n-gram of all of them."""
    for lo, _, own, _ in _cut(column, n):
        yield lo, own


def bitmap(s: np.ndarray, load: float = 1.0) -> np.ndarray:
    """Each bit is the parity of the number of elements hashed to it: at most `load` elements a bit, 128 bits at least. With 2 a bit, sets of one size without a common element can look 0.78 alike, with 1 some 0.61.

    Two bitmaps differ in no more bits than there are elements in one set alone. A bitmap folds to half its
    size by xor of its halves, so sets of unlike sizes compare as well.
    """
    n = 1 << max(7, int(np.ceil(np.log2(max(1, len(s) / load)))))
    at = (s >> np.uint64(32)).astype(np.int64) & (n - 1)
    return np.packbits((np.bincount(at, minlength=n) & 1).astype(np.uint8)).view(np.uint64)


class Bitmaps:
    """Bitmaps of one group, by size, for comparing one with many."""

    def __init__(self, maps: list[np.ndarray]):
        self.maps = maps
        self.size = np.fromiter(map(len, maps), np.int64, len(maps))
        self.tables: dict[int, np.ndarray] = {}

    def _table(self, n: int) -> np.ndarray:
        """All maps of size n and, folded, those of 2 n; others stay empty."""
        if n not in self.tables:
            t = np.zeros((len(self.maps), n), np.uint64)
            for k in np.flatnonzero(self.size == n):
                t[k] = self.maps[k]
            for k in np.flatnonzero(self.size == 2 * n):
                t[k] = self.maps[k][:n] ^ self.maps[k][n:]
            self.tables[n] = t
        return self.tables[n]

    def differing(self, i: int, j: np.ndarray) -> np.ndarray:
        """Bits in which map i and the maps j, none smaller, differ; 0 where j is more than twice as large."""
        n = int(self.size[i])
        t = self._table(n)
        out = np.bitwise_count(t[j] ^ t[i]).sum(1, dtype=np.int64)
        out[self.size[j] > 2 * n] = 0
        return out


def _linked_at_most(na: np.ndarray, nb: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can link when at least `differing` elements are in one of them alone."""
    most = (na + nb - differing) // 2
    return 100 * most >= percent * (na + nb - most)


def _described(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, COUNTERS), np.int64)
        names = ["doc_id", "node", "tie", "n", "k1", "k2", "bits", "piece", "counts"]
        for batch in batches:
            for lo, words, own, _ in _cut(batch.column(3), n):
                size = np.array([len(s) for s in own])
                every = np.concatenate(own) if own else np.zeros(0, np.uint64)
                for sketch, hashes in zip(counts, (words, every), strict=True):
                    sketch += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                ends = np.cumsum(size)
                k1, k2 = (T.sets_hashed(every, ends - size, ends, c) for c in (0, 1))
                none = pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[lo : lo + len(own)] for k in range(3)), pa.array(size.astype(np.int32)), pa.array(T.signed(k1)), pa.array(T.signed(k2)), pa.array([bitmap(s).tobytes() for s in own], pa.binary()), *none], names)
        step = COUNTERS // PIECES
        packed = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in counts.reshape(-1, step)]
        none = [pa.nulls(2 * PIECES, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(2 * PIECES), pa.int32()), pa.array(packed, pa.binary())], names)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the sketches' pieces that a task reads."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            c = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
            total[piece] = total[piece] + c if piece in total else c
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(np.minimum(c, (1 << 32) - 1).astype("<u4").tobytes(), 1) for c in total.values()], pa.binary())], ["piece", "counts"])


def _order(words: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(cost of a word, least cost of an n-gram) of each counter of the sketches. Costs of an n-gram's words add up to the logarithm of how often chance brings them together; n-grams met more often than that cost as much as if it were chance."""
    grew = max(1.0, float(words.sum()))
    mean = grams.mean()
    over = grams - mean
    often = np.zeros(COUNTERS, np.uint16)
    on = np.flatnonzero(over > 8 * np.sqrt(mean) + 8)
    often[on] = np.minimum(STEPS * (np.log2(over[on]) + (n - 1) * np.log2(grew)), 65535)
    return (STEPS * np.log2(words + 1)).astype(np.uint16), often


def _prefixes(n: int, percent: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, often = sent.value
        for batch in batches:
            for _, _, own, costs in _cut(batch.column(0), n, cost):
                held = [k for k, s in enumerate(own) if len(s)]
                if not held:
                    continue
                size = np.array([len(own[k]) for k in held])
                every = np.concatenate([own[k] for k in held])
                ends = np.cumsum(size)
                key = T.sets_hashed(every, ends - size, ends)
                rank = np.maximum(np.concatenate([costs[k] for k in held]), often[(every & np.uint64(COUNTERS - 1)).astype(np.int64)])
                # An element is its place in the order: elements that agree in it and in 48 bits are taken for one, which verifying corrects.
                every = np.minimum(rank, 65535).astype(np.uint64) << np.uint64(48) | every >> np.uint64(16)
                take = size - (percent * size + 99) // 100 + 1
                out = [np.partition(every[end - n_all : end], most - 1)[:most] for end, n_all, most in zip(ends, size, take, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(np.concatenate(out))), pa.array(T.signed(np.repeat(key, take))), pa.array(np.repeat(size, take).astype(np.int32))], ["element", "k1", "n"])

    return run


def _forest(ids: np.ndarray, label: np.ndarray, can: "callable") -> list[tuple[int, int]]:
    """Stars that connect what `can(i)`, the later partners of i, connects and `label` (numbers from 0) doesn't yet: the smallest id of each label with the smallest of all that it is connected with. Stops when all is one."""
    before, label = label, label.copy()
    for i in range(len(label) - 1):
        if (label == label[0]).all():
            break
        for j in can(i, label):
            if label[j] != label[i]:
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    # Stars instead of the links met: their components are the same, and rounds over them are fewer.
    least = np.full(int(before.max()) + 1, np.iinfo(np.int64).max)
    hub, to = least.copy(), np.zeros(len(least), np.int64)
    to[before] = label
    np.minimum.at(least, before, ids)
    np.minimum.at(hub, to, least)
    return [(x, y) for x, y in zip(hub[to].tolist(), least.tolist(), strict=True) if x != y]


def _pairs(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(e.min(1) if len(e) else e[:, 0]), pa.array(e.max(1) if len(e) else e[:, 0])], ["a", "b"])


def _tasks(edges_of):
    """Edges of each pair of tiles, from rows (key, tile, class_id, label, ...) sorted by key; edges_of takes such rows of one key."""

    def run(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        found: list = []

        def close(rows: tuple) -> None:
            cuts = np.r_[0, np.flatnonzero(np.diff(rows[0])) + 1, len(rows[0])]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo > 1:
                    found.extend(edges_of(*(x[lo:hi] for x in rows[1:])))

        for got in rows:
            if not len(got[0]):
                continue
            rows_ = got if held is None else tuple(np.concatenate([a, b]) if isinstance(a, np.ndarray) else a + b for a, b in zip(held, got, strict=True))
            last = int(np.searchsorted(rows_[0] != rows_[0][-1], False)) if rows_[0][0] == rows_[0][-1] else int(np.flatnonzero(rows_[0] != rows_[0][-1])[-1]) + 1
            close(tuple(x[:last] for x in rows_))
            held = tuple(x[last:] for x in rows_)
            if len(found) > 1 << 15:
                yield _pairs(found)
                found.clear()
        if held is not None:
            close(held)
        yield _pairs(found)

    return run


def _partners(n: np.ndarray, tile: np.ndarray, maps: Bitmaps, percent: int):
    """can(i) for _forest: later classes, of the other tile if there are two, of another label, near enough in size and by their bitmaps."""
    one = (tile == tile[0]).all()

    def can(i: int, label: np.ndarray) -> np.ndarray:
        to = int(np.searchsorted(n, 100 * n[i] // percent, "right"))
        j = np.flatnonzero(label[i + 1 : to] != label[i]) + i + 1
        if not one:
            j = j[tile[j] != tile[i]]
        return j[_linked_at_most(n[i], n[j], maps.differing(i, j), percent)] if len(j) else j

    return can


def _candidates(percent: int):
    """Edges between classes that share an element and may link: a forest for each pair of tiles, from rows (key, tile, class_id, label, n, bits)."""
    seen: set = set()

    def edges_of(tile: np.ndarray, ids: np.ndarray, label: np.ndarray, n: np.ndarray, bits: list[bytes]) -> list[tuple[int, int]]:
        # Copies share many elements: the same classes under another element give the same edges.
        key = sha256(ids.tobytes() + tile.tobytes()).digest()
        if key in seen:
            return []
        if len(seen) > 1 << 17:
            seen.clear()
        seen.add(key)
        order = np.lexsort((ids, n))
        ids, n, tile = ids[order], n[order], tile[order]
        maps = Bitmaps([np.frombuffer(bits[k], np.uint64) for k in order])
        return _forest(ids, np.unique(label[order], return_inverse=True)[1], _partners(n, tile, maps, percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*(b.column(k).to_numpy() for k in range(4)), b.column(4).to_numpy().astype(np.int64), b.column(5).to_pylist()) for b in batches)
        yield from _tasks(edges_of)(rows)

    return run


def _verified(n: int, percent: int):
    """Links inside pairs of tiles, from rows (key, tile, class_id, label, text) sorted by key."""

    def edges_of(tile: np.ndarray, ids: np.ndarray, label: np.ndarray, own: list[np.ndarray]) -> list[tuple[int, int]]:
        size = np.array([len(s) for s in own])
        order = np.lexsort((ids, size))
        ids, size, tile, own = ids[order], size[order], tile[order], [own[k] for k in order]
        near = _partners(size, tile, Bitmaps([bitmap(x, 0.5) for x in own]), percent)

        def can(i: int, label: np.ndarray) -> Iterator[int]:
            for k in near(i, label):
                if label[k] != label[i]:
                    both = len(np.intersect1d(own[i], own[k], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[k] - both):
                        yield k

        return _forest(ids, np.unique(label[order], return_inverse=True)[1], can)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*(b.column(k)[lo : lo + len(own)].to_numpy() for k in range(4)), own) for b in batches for lo, own in sets(b.column(4), n))
        yield from _tasks(edges_of)(rows)

    return run


_PAIR = "a long, b long"


def _band(percent: int):
    """A little wider than the ratio of sizes that can link, so that rounding parts no two of them by more than a band."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.1 / percent))).cast("int")


def _groups(rows: DataFrame, percent: int) -> DataFrame:
    """(class_id, label, n, key, tile) of (element, class_id, n): a task for each different group of classes that share an element.

    A class goes where no other of the element is near enough in size: none can link with it. Near copies share most of their elements; groups of the same classes have the same key and are one.
    """
    by_size = Window.partitionBy("element").orderBy("n")
    near = F.lit(False)
    for other in (F.lag("n").over(by_size), F.lead("n").over(by_size)):
        near |= other.isNotNull() & (100 * F.least("n", other).cast("long") >= percent * F.greatest("n", other).cast("long"))
    rows = rows.withColumn("_near", near).where("_near")
    group = Window.partitionBy("element")
    marks = [F.bit_xor(F.xxhash64("class_id", "n", F.lit(k))).over(group) for k in range(2)]
    return rows.select("class_id", F.col("class_id").alias("label"), "n", F.xxhash64(F.count("*").over(group), *marks).alias("key"), F.lit(0).cast("long").alias("tile")).distinct()


def _tile_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(class_id, label, n, key, tile) of (block, class_id, n, label): each class under every pair of tiles that its own tile is in.

    A block that fits one tile is one. Labels that fill more than a tile of a band have tiles of their own, which aren't paired with each other.
    """
    total = shared.freed(rows.groupBy("block").agg(F.count("*").alias("n_all")).select("block", F.col("n_all").alias("n")), "jaccard-groups")
    fits = total.where(F.col("n") <= TILE).select("block")
    own = F.struct("band", "pure", "of", "sub")
    alone = rows.join(fits.hint("merge"), "block", "left_semi").select("class_id", "label", "n", F.xxhash64("block").alias("key"), F.lit(0).cast("long").alias("tile"))
    large = total.where(F.col("n") > TILE)
    if large.isEmpty():
        return alone
    rows = shared.freed(shared.spread_join(rows, large.select("block"), ["block"], total, ["class_id"]).withColumn("band", _band(percent)), "jaccard-large")
    labels = shared.freed(rows.groupBy("block", "band", "label").agg(F.count("*").alias("n")), "jaccard-labels")
    pure = labels.select("block", "band", "label", (F.col("n") > TILE).alias("pure"))
    bare, rows = rows, shared.freed(shared.spread_join(rows, pure, ["block", "band", "label"], labels, ["class_id"]).withColumn("of", F.when(F.col("pure"), F.col("label")).otherwise(F.lit(0))), "jaccard-pure")
    shared.removed(bare)
    many = labels.withColumn("pure", F.col("n") > TILE).withColumn("of", F.when(F.col("pure"), F.col("label")).otherwise(F.lit(0)))
    many = shared.freed(many.groupBy("block", "band", "pure", "of").agg(F.sum("n").alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")), "jaccard-tiles")
    # Written between the joins: as one query they have so many stages at once that the driver's memory shows it.
    parted, rows = rows, shared.freed(shared.spread_join(rows, many.drop("n"), ["block", "band", "pure", "of"], many, ["class_id"]).withColumn("sub", F.pmod(F.xxhash64("class_id"), F.col("tiles")).cast("int")), "jaccard-dealt")
    shared.removed(parted)
    every = many.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("block", own.alias("other"))
    near = every.select("block", F.explode(F.array(*[F.col("other.band") + k for k in (-1, 0, 1)])).alias("band"), "other").groupBy("block", "band").agg(F.collect_list("other").alias("others"))
    sizes = labels.groupBy("block", "band").agg(F.sum("n").alias("n"))
    rows = shared.spread_join(rows, near, ["block", "band"], sizes, ["class_id"]).withColumn("own", own).withColumn("other", F.explode("others"))
    rows = rows.where(~(F.col("pure") & F.col("other.pure") & (F.col("of") == F.col("other.of"))))
    keyed = rows.select("class_id", "label", "n", F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.xxhash64("own").alias("tile"))
    return alone.unionByName(keyed)


def _stars(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((class_id, label, n, key, tile), tables read): each class of rows (element, class_id, n, band) with the smallest class of its band that it shares most elements with."""
    hubs = shared.freed(rows.groupBy("element", "band").agg(F.min("class_id").alias("hub"), F.count("*").alias("n")), "star-hubs")
    met = shared.spread_join(rows, hubs.drop("n"), ["element", "band"], hubs, ["class_id"]).where("hub <> class_id").groupBy("class_id", "hub").agg(F.count("*").alias("times"), F.max("n").alias("n"))
    best = shared.freed(met.groupBy("class_id").agg(F.min_by("hub", F.struct(-F.col("times"), F.col("hub"))).alias("hub"), F.max("n").alias("n")), "stars")
    per = shared.freed(best.groupBy("hub").agg(F.count("*").alias("n")), "star-sizes")
    dealt = shared.spread_join(best, per.select("hub", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), ["hub"], per, ["class_id"])
    rays = dealt.select("class_id", F.col("class_id").alias("label"), "n", F.xxhash64("hub", F.pmod(F.xxhash64("class_id"), F.col("tiles"))).alias("key"), F.lit(1).cast("long").alias("tile"))
    middle = per.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / TILE) - 1)))
    middle = middle.select(F.col("hub").alias("class_id"), F.col("hub").alias("label"), F.lit(0).alias("n"), F.xxhash64("hub", "sub").alias("key"), F.lit(0).cast("long").alias("tile"))
    return rays.unionByName(middle), [hubs, best, per]


def _joined(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, tie_col: str | None = None, node_col: str | None = None) -> DataFrame:
    """(doc_id, node, tie, n, component) of every row of docs; see jaccard_join. component is the smallest node; nodes are ids, or what node_col has."""
    spark = docs.sparkSession
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    # Above all ids: the smallest of a component is an id if there is one.
    node = F.col(node_col) if node_col else F.coalesce(doc_id, F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_ID)))
    texts = docs.select(doc_id.alias("doc_id"), node.alias("node"), (F.col(tie_col) if tie_col else F.lit(None).cast("long")).alias("tie"), text.alias("text"))
    # The sketch's rows come with the described documents', so texts are read once for both.
    told = shared.written(texts.mapInArrow(T.giving_back(_described(n)), "doc_id long, node long, tie long, n int, k1 long, k2 long, bits binary, piece int, counts binary"), "jaccard-sets")
    described = told.where("piece is null").select("doc_id", "node", "tie", "n", "k1", "k2", "bits")
    pieces = told.where("piece is not null").select("piece", "counts")
    summed = pieces.repartition(2 * PIECES, "piece").mapInArrow(_added, "piece int, counts binary").collect()
    counts = np.zeros((2, COUNTERS), np.int64)
    for piece, packed in summed:
        counts.reshape(2 * PIECES, -1)[piece] += np.frombuffer(zlib.decompress(bytes(packed)), "<u4")
    order = spark.sparkContext.broadcast(_order(*counts, n))
    del counts, summed

    classes = described.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("node").alias("class_id"), F.min("bits").alias("bits"), F.count("*").alias("copies"))
    classes = shared.freed(classes, "jaccard-classes")
    # Read twice, so texts are cut into shingles once for both.
    elements = shared.written(texts.select("text").mapInArrow(T.giving_back(_prefixes(n, percent, order)), "element long, k1 long, n int"), "elements")
    common = elements.groupBy("element").agg(F.min("k1").alias("k_min"), F.max("k1").alias("k_max"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("n")).where("k_min <> k_max")
    # Two texts alone that are too unlike in size, which is how most elements that chance shares are shared, can't link.
    far = (F.col("n") == 2) & (100 * F.col("least").cast("long") < percent * F.col("most").cast("long"))
    common = shared.freed(common.where(~far).select("element", "n"), "shared-elements")
    # Elements that no two classes share stay where they are.
    met = shared.maybe_in(F.col("element"), shared.filter_of(common, F.col("element")))
    members = shared.spread_join(elements.where(met).select("element", "k1"), common.select("element"), ["element"], common, ["k1"]).distinct()
    members = shared.freed(members.join(classes.select("k1", "class_id", "n").hint("merge"), "k1").select("element", "class_id", "n"), "element-members")
    shared.removed(elements, common)

    def links(keyed: DataFrame) -> DataFrame:
        keyed = shared.freed(keyed, "jaccard-keyed")
        # Texts that no tile asks for stay where they are.
        asked = texts.where(shared.maybe_in(F.col("node"), shared.filter_of(keyed, F.col("class_id"))))
        one = asked.join(keyed.hint("merge"), asked["node"] == keyed["class_id"]).select("key", "tile", "class_id", "label", "text")
        found = shared.freed(one.repartition("key").sortWithinPartitions("key", "class_id").mapInArrow(T.giving_back(_verified(n, percent)), _PAIR), "jaccard-links")
        shared.removed(keyed)
        return found

    # Elements with more classes than a tile holds; all others are a task each.
    large = shared.freed(members.groupBy("element").agg(F.count("*").alias("n")).where(F.col("n") > TILE), "large-elements")
    small = members.join(large.select("element").hint("merge"), "element", "left_anti")
    # Groups, tiles and candidates are a query each, and what components() reads twice is a table.
    keyed = shared.freed(_groups(small, percent), "jaccard-keyed")
    over = [members, large, keyed]
    if large.isEmpty():
        met, labels = spark.createDataFrame([], _PAIR), None
    else:
        wide = shared.freed(shared.spread_join(members, large.select("element"), ["element"], large, ["class_id"]).withColumn("band", _band(percent)), "star-members")
        stars, used = _stars(wide)
        met = links(stars)
        # The smallest of a component and the class itself: its label.
        labels = graph.components(met).select(F.col("node").alias("class_id"), F.col("component").alias("label")).unionByName(wide.select("class_id", F.col("class_id").alias("label")))
        labels = shared.freed(labels.groupBy("class_id").agg(F.min("label").alias("label")), "star-labels")
        wide = shared.freed(wide.join(labels.hint("merge"), "class_id"), "star-labelled")
        parted = wide.groupBy("element").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).where("least <> most")
        parted = shared.freed(parted.select("element", "n"), "open-elements")
        open_ = shared.spread_join(wide, parted.select("element"), ["element"], parted, ["class_id"]).select(F.col("element").alias("block"), "class_id", "n", "label")
        tiles = shared.freed(_tile_pairs(open_, percent), "jaccard-keyed")
        keyed = keyed.unionByName(tiles)
        over += [tiles, wide, parted, met, *used]
    tasks = keyed.join(classes.select("class_id", "n", "bits").hint("merge"), ["class_id", "n"]).select("key", "tile", "class_id", "label", "n", "bits")
    candidates = shared.freed(tasks.repartition("key").sortWithinPartitions("key", "class_id").mapInArrow(T.giving_back(_candidates(percent)), _PAIR), "jaccard-candidates")
    blocks = graph.components(candidates.unionByName(met)).select(F.col("node").alias("class_id"), F.col("component").alias("block"))
    blocks = blocks.join(classes.select("class_id", "n").distinct().hint("merge"), "class_id")
    own = blocks.select("class_id", F.col("class_id").alias("label"))
    own = own if labels is None else own.unionByName(labels).groupBy("class_id").agg(F.min("label").alias("label"))
    blocks = shared.freed(blocks.join(own.hint("merge"), "class_id").select("block", "class_id", "n", "label"), "jaccard-blocks")
    parted = shared.freed(blocks.groupBy("block").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).where("least <> most").select("block", "n"), "parted-blocks")
    parts = shared.spread_join(blocks, parted.select("block"), ["block"], parted, ["class_id"])
    found = links(_tile_pairs(parts, percent))
    joined = graph.components(found.unionByName(met)).withColumnRenamed("node", "class_id")
    shared.removed(*over, candidates, blocks, parted, found)

    found = classes.select("k1", "k2", "class_id", F.col("copies").alias("n")).join(joined.hint("merge"), "class_id", "left").select("k1", "k2", F.coalesce("component", "class_id").alias("component"), "n")
    found = shared.freed(found, "class-components")
    mine = shared.spread_join(described.select("doc_id", "node", "tie", "n", "k1", "k2"), found.drop("n"), ["k1", "k2"], found, ["node"], "left")
    return mine.withColumn("component", F.coalesce("component", "node"))


def jaccard_join(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Two documents link when 100 * |A and B| >= percent * |A or B| of their sets of n-grams; component_id is the smallest id that links
    reach. Null texts and texts without words have empty sets and link with nothing; texts of fewer than n words have one n-gram. Rows
    that repeat an id are one node with the links of each, and come out once each. Rows without an id link as all others do (those of one text are one node); their component_id
    is null where no row with an id is reached. An empty table gives an empty result. Other columns are not read. No link is lost: prefixes, bitmaps and
    labels only leave out what cannot link or what links connect already.
    """
    component = F.when((F.col("component") < NO_ID) | F.col("doc_id").isNotNull(), F.col("component"))
    return _joined(docs, n, percent, id_col, text_col).select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def repeated(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, tie_col: str, node_col: str) -> DataFrame:
    """(node, tie, stays) of each component of more than one row with words, each once: the smallest id stays, rows without one after all others, then the smallest node and tie.

    Rows of one node are taken as linked; where rows of one id may differ, node_col tells their texts apart.
    """
    joined = shared.freed(_joined(docs, n, percent, id_col, text_col, tie_col, node_col).where("n > 0").select("doc_id", "node", "tie", "component"), "jaccard-joined")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "tie")
    groups = shared.freed(joined.groupBy("component").agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1"), "jaccard-copies")
    met = shared.spread_join(joined, groups.drop("n"), ["component"], groups, ["node", "tie"])
    met = shared.freed(met.select("node", "tie", (row == F.col("first")).alias("stays")).distinct(), "jaccard-repeated")
    shared.removed(joined, groups)
    return met


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g FROM w
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.a = w.doc_id GROUP BY 1
"""
