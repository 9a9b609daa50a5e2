"""Fill-in-middle, periodic runs and SimHash against plain loops over whole tables and hostile texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import DATA
from tickloom.llm import fill_middle, periodic_runs, queries, simhash

SF = f"{DATA}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# Fill-in-middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    s = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    p, m, x = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<P>{p}<S>{x}<M>{m}" if form == "psm" else f"<S>{x}<P>{p}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text)


def test_fill_middle_on_hostile_texts(spark, tmp_path):
    rng = random.Random(1)
    alphabet = ["\u0001", "\u0002", "e", "d", " ", "\t", "\n", " ", "<", "P", ">", "<P", "S>", "$0", "\\", "é", "\U0001f600", "\u0085", "word"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(800)] + [None, "", " ", "<M>", "a <P> b", "x" * 100_000 + " y" * 50_000]
    at = str(tmp_path)
    docs_of(spark, texts).write.parquet(f"{at}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in fill_middle.query(spark, at).collect()}
    assert got == {i: plain_fim(i, t) for i, t in enumerate(texts)}
    assert {f for _, f, *_ in got.values()} == {"plain", "psm", "spm"}
    assert "ArrowEvalPython" not in (plan := fill_middle.query(spark, at)._jdf.queryExecution().toString()) and "Exchange" not in plan


def test_fill_middle_parts(spark):
    out = fill_middle.fill_in_middle(docs_of(spark, ["one  two\nthree ", "a"] * 40), rate=100)
    for r in out.collect():
        text = "one  two\nthree " if r.doc_id % 2 == 0 else "a"
        assert r.prefix + r.middle + r.suffix == text and r.n == (4 if r.doc_id % 2 == 0 else 1)
    rows = spark.createDataFrame([(None, "a b c"), (None, None), (3, "a b c"), (3, "a b c")], "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("form", F.lit(1))
    assert [r.n for r in fill_middle.fill_in_middle(rows).orderBy("n").collect()] == [0, 3, 3, 3]
    assert fill_middle.fill_in_middle(rows.limit(0)).count() == 0


# Periodic runs


def plain_runs(words):
    """Each place where the smallest period of a stretch that can't be made longer is q, by the definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def digest(words):
    runs = plain_runs(words)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(plain_collapsed(words, runs))


def repetitive(rng, size):
    out = []
    while len(out) < size:
        base = [rng.choice("ab") for _ in range(rng.randrange(1, 9))]
        out += (base * rng.randrange(1, 12))[: rng.randrange(1, 60)]
    return out[:size]


@pytest.mark.parametrize("pieces", [1, 3, 50])
def test_scan_against_the_definition(pieces):
    rng = random.Random(pieces)
    docs = [repetitive(rng, rng.randrange(0, 260)) for _ in range(250)] + [["a"] * 200, ["a", "b"] * 90 + ["c"], []]
    words = [[w.encode() for w in d] for d in docs]
    top = max(map(len, docs)) // 4
    cuts = np.linspace(0, top, pieces + 1).astype(int)
    got = [sorted((r for lo, hi in zip(cuts[:-1], cuts[1:]) for r in periodic_runs.runs_of([w], int(lo) + 1, int(hi))[0]), key=lambda r: (r[0], r[2])) for w in words]
    assert got == list(map(plain_runs, docs))
    if pieces == 1:
        assert periodic_runs.runs_of(words) == got


def test_periodic_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.query(spark, SF).collect()}
    want = {r.doc_id: digest(planted(r.doc_id, WORD.findall(r.text or ""))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == want and sum(x[0] > 0 for x in got.values()) > 10


def test_periodic_ranges_of_lags(spark):
    """With few lags a task most documents are dealt out by ranges; a third of all rows repeat one long text."""
    rng = random.Random(5)
    texts = [" ".join(repetitive(rng, rng.randrange(0, 400))) for _ in range(60)] + ["x y z " * 90] * 30 + [None, "", " \n"]
    docs = docs_of(spark, texts).withColumn("runs", F.lit("clash")).withColumn("key", F.lit(0))
    for lags in (4, 2_048):
        got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs, lags=lags).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            w = WORD.findall(t or "")
            runs = plain_runs(w)
            assert [tuple(x) for x in got[i].runs] == runs and got[i].collapsed == plain_collapsed(w, runs) and got[i].n_words == len(w)
    again = spark.createDataFrame([(1, "a " * 30), (1, "a " * 30), (None, "a " * 30), (None, "b")], "doc_id long, text string")
    assert sorted(r.collapsed for r in periodic_runs.periodic_runs(again, lags=4).collect()) == ["a", "a", "a", "b"]
    assert periodic_runs.periodic_runs(again.limit(0)).count() == 0


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=3):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and root(i) != root(j):
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


def test_simhash_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip([f"{x:016x}" for x in fps], plain_components([r.doc_id for r in rows], fps), strict=True), strict=True))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.queries()["op13_simhash"](spark, SF).collect()}
    assert got == want and len({c for _, c in got.values()}) < len(got)


def test_simhash_messy_rows(spark):
    texts = ["one two three four", "ONE two\tthree  four", None, "", " \n", "a", "Ünï ÇÖDÉ ça", "a b", "w " * 60_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "one two three four"), (None, "of no id and unlike all others here"), (0, "a b c d e f g"), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("label", F.lit(1))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash(docs).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(((d, f"{x:016x}", c) for (d, _), x, c in zip(rows, fps, plain_components([d for d, _ in rows], fps), strict=True)), key=str)
    assert got == want
    assert simhash.simhash(docs.limit(0)).count() == 0


def near_numbers(rng, clusters, size, reach):
    out = set()
    for _ in range(clusters):
        x = rng.getrandbits(64)
        for _ in range(size):
            for _ in range(rng.randrange(reach + 1)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def test_tree_and_forest_against_all_pairs():
    rng = random.Random(2)
    fps = near_numbers(rng, 20, 25, 4)
    tree = simhash.Tree()
    for i, x in enumerate(fps):
        tree.add(x, i % 3)
    for x in fps[::7]:
        near = {i for i, y in enumerate(fps) if (x ^ y).bit_count() <= 3}
        assert set(tree.near(x, 3)) == near
        assert {i for i in tree.near(x, 3, 1) if i % 3 != 1} == {i for i in near if i % 3 != 1}
    assert len(simhash.forest(fps, 3)) == len(fps) - len(set(plain_components(range(len(fps)), fps)))


@pytest.mark.parametrize("shard", [4, 16, 1_024])
def test_links_of_split_shards(spark, shard):
    """Walks of near numbers, so large route values of several components, and a dense ball; shards of 4 split nearly all of them."""
    rng = random.Random(shard)
    fps = near_numbers(rng, 15, 12, 5)
    centre = rng.getrandbits(64)
    fps = sorted({*fps, *(centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)), *(rng.getrandbits(48) << 16 for _ in range(60))})
    pairs = simhash.links(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long"), 3, shard).collect()
    at = {simhash._signed(x): i for i, x in enumerate(fps)}
    assert all(((a & simhash._ALL) ^ (b & simhash._ALL)).bit_count() <= 3 for a, b in pairs)
    up = list(range(len(fps)))
    for a, b in pairs:
        up[simhash._root(up, at[a])] = simhash._root(up, at[b])
    ours, theirs = [simhash._root(up, i) for i in range(len(fps))], plain_components(range(len(fps)), fps)
    assert len(set(zip(ours, theirs, strict=True))) == len(set(ours)) == len(set(theirs))


@pytest.mark.parametrize("size", [10, 10**8, 10**11, 10**14])
def test_routes_lose_nothing(size):
    """Whatever three bits differ, some mask leaves all of them out."""
    masks = simhash.routes(size)
    rng = random.Random(3)
    for _ in range(3_000):
        bits = sum(1 << k for k in rng.sample(range(64), 3))
        assert any(not m & bits for m in masks)
