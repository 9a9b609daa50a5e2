"""Operators that SQL cannot express, against plain Python on small tables, exact round trips or held-out rows."""

import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tickloom.llm import decontamination as dec
from tickloom.llm import jaccard_join, language_id, line_dedup, quality, shared, substring_dedup, token_output, toxicity

SF = f"{DATA}/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def thue_morse(n):
    t = "a"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t


#: Words of 1,024 letters, each other's complement: polynomial hashes modulo a power of two take them for equal.
TM = thue_morse(10)
MT = TM.translate(str.maketrans("ab", "ba"))


def template(text):
    upper = re.compile("[A-ZÀ-ÖØ-Þ]")
    out, end, was_number, digits_before = [], None, False, False
    for m in re.finditer("[A-Za-z0-9\u0080-\U0010ffff]+", text or ""):
        w = m.group()
        low = re.sub("[A-ZÀ-ÖØ-Þ]", lambda x: x.group().lower(), w)
        opens = end is None or bool(re.search("[.!?:\n]", text[end : m.start()]))
        digits = w[0] in "0123456789"
        number = digits or low in dec.NUMBER_WORDS
        unit = was_number and low in dec.UNITS
        name = bool(upper.match(w)) and len(w) > 1 and not opens
        kind = ("number" if number else "unit" if unit else "name") if number or unit or name else None
        gap = text[end : m.start()] if end is not None else ""
        same = out and out[-1][0] == kind
        if same and (kind == "number" and (digits and digits_before and gap in {".", ",", "/"} or not digits and not digits_before and gap in {" ", "-"}) or kind == "name" and gap == " "):
            out[-1] = (kind, out[-1][1] + (low,))
        else:
            out.append((kind, (low,)))
        end, was_number, digits_before = m.end(), number, digits
    return out


def windows(tokens, n, item):
    """Windows by their templates if they have plain words enough; as they are otherwise, and where an item has one window alone. Documents' as both."""
    for p in range(len(tokens) - n + 1):
        w = tokens[p : p + n]
        enough = sum(k is None for k, _ in w) >= min(dec.LITERALS, n)
        if enough and n >= dec.LITERALS:
            yield p, tuple(k or x for k, x in w), tuple(x for k, x in w if k)
        if not item or not enough or len(tokens) == n:
            yield p, tuple(x for _, x in w), ()


def brute_matches(docs, items):
    lines, sizes = defaultdict(list), {}
    index = defaultdict(list)
    for i, text in items:
        t = template(text)
        own = list(windows(t, min(len(t), dec.WINDOW), True)) if t else []
        sizes[i] = len({p for p, _, _ in own})
        for p, w, s in own:
            index[w].append((i, p, s))
    lengths = {min(len(template(text)), dec.WINDOW) for _, text in items} - {0}
    for d, text in docs:
        t = template(text)
        for n in lengths:
            for p, w, s in windows(t, n, False):
                for i, q, theirs in index.get(w, ()):
                    lines[d, i, p - q].append((q, theirs, s))
    out = Counter()
    for (d, i, _), rows in lines.items():
        pairs = {x for _, a, b in rows for x in zip(a, b, strict=True)}
        alike = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
        if n := len({q for q, a, b in rows if alike or a == b}):
            out[d, i] += n
    return {(d, i, n, sizes[i]) for (d, i), n in out.items()}


def test_decontamination(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    item = "Anna walked 12 miles to the old market and bought three baskets of ripe plums for her sister"
    docs += [(10_001, f"It was late. {item.replace('12', '40')} again."), (10_002, item.replace("walked", "drove"))]
    docs += [(10_003, "We know that Otto paid 5 coins for 5 pears, then kept 5 of them for the long trip"), (10_004, "We know that Otto paid 5 coins for 6 pears, then kept 7 of them for the long trip")]
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    items += [(901, item), (902, "We know that Carl paid 8 coins for 8 pears, then kept 8 of them for the long trip")]
    got = dec.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.n_windows, r.item_windows) for r in got.collect()}
    assert got == brute_matches(docs, items)
    assert {d for d, i, _, _ in got if i == 902} == {10_003} and (10_001, 901) in {x[:2] for x in got}


def test_decontamination_keeps_verbatim_windows(spark):
    """Expected by hand: windows are of 10 tokens, so an item of k tokens has k - 9, or one of all if it is shorter."""
    passage = "We know that Carl paid 3 coins for 3 pears and then he sat by the river until the sun went down behind the far green hills"
    sums, names, short = "3 17 20 4 18 22 5 19 24 6 20 26", "They were Anna Berta Carla Dora Emma Frieda Greta Hanna Ida Jana", "12 7 84"
    opening = "Plums are sold at the old market on every morning"
    items = [(1, passage), (2, sums), (3, names), (4, short), (5, opening)]
    docs = [
        (1, passage.replace("3 pears", "4 pears")), (2, f"A table: {sums}."), (3, f"We heard a list. {names}"), (4, f"So {short} it is"), (5, f"As all of us said Plums{opening[5:]}"),
        (6, sums.replace("4 18 22", "4 18 23")), (7, "So 12 7 85 it is"), (8, names.replace("Dora", "Doris")), (9, passage.replace("3 coins for 3", "5 coins for 5")),
    ]
    got = dec.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    # A run of names is one token, so item 3 has three tokens and matches as it is.
    # Item 1 has 27 tokens, the changed one of document 1 is its ninth: 9 of 18 windows hold it. Document 9 fills its slots alike, and the same 9 windows hold values.
    # Item 4 alone has fewer than five words.
    want = {(1, 1, 9, 9, 18, False), (2, 2, 3, 3, 3, False), (3, 3, 1, 1, 1, False), (4, 4, 1, 1, 1, True), (5, 5, 1, 1, 1, False), (9, 1, 18, 9, 18, False)}
    assert {tuple(r) for r in got} == want


PEOPLE = "Anna Otto Maria Carl Berta Hugo Greta Emil Paula Ivan".split()
THINGS = "baskets plums roads letters horses candles barrels ribbons lanterns stones".split()


def reworded(rng, text):
    """The text with each value replaced by another way of writing another value, all the same in all places."""
    numbers = ["3.5", "1,000", "twenty five", "7/8", "forty", "12", "90", "six hundred"]
    people = ["Anna Maria", "PAUL", "Jean Paul", "Olga", "DNA"]
    own = {}
    for v in dict.fromkeys(re.findall("[0-9]+|" + "|".join(PEOPLE), text)):
        pool = [x for x in (numbers if v[0].isdigit() else people) if x not in own.values()]
        own[v] = pool[rng.integers(len(pool))]
    return re.sub("[0-9]+|" + "|".join(PEOPLE), lambda m: own[m.group()], text)


@pytest.mark.parametrize("literals, least", [(3, 1.0), (5, 0.9), (8, 0.0)])
def test_decontamination_recall_of_reparameterised_items(spark, literals, least):
    """Questions whose numbers and names are all replaced, in other forms too, each in a document of its own. Recall falls as more plain words are asked for."""
    rng = np.random.default_rng(9)
    pick = lambda x: x[rng.integers(len(x))]
    items, docs = [], []
    for k in range(200):
        a, b = rng.choice(PEOPLE, 2, replace=False)
        n, m = rng.choice(np.arange(2, 99), 2, replace=False)
        text = f"On that day {a} counted {n} {pick(THINGS)} near the old {pick(THINGS)} and gave {b} {m} more {pick(THINGS)}, then {a} asked how many {pick(THINGS)} number {k} was worth to {b} in the end"
        items.append((k, text))
        docs.append((k, f"Nothing to see here. {reworded(rng, text)} after all of this."))
        docs.append((1000 + k, f"In this town {pick(PEOPLE)} sold {n} old {pick(THINGS)} to all of us and nobody asked {pick(PEOPLE)} why {m} of them were so small"))
    got = dec.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), literals=literals).collect()
    assert not {r.doc_id for r in got if r.doc_id >= 1000}
    recall = len({r.doc_id for r in got if r.doc_id == r.item_id}) / 200
    assert recall >= least, recall


def test_language_id_is_naive_bayes(spark):
    """Against a dictionary of counts, with the buckets of n-grams from plain loops."""
    docs = [(1, "the old house", "en"), (2, "das alte Haus", "de"), (3, "la vieille maison, là", "fr"), (4, "The house", "en"), (5, None, "de"), (6, "das", None), (7, "haus & maison 12", "xx")]
    mask = (1 << 64) - 1

    def grams(text):
        chars = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        chars, out = re.sub(" +", " ", chars), []
        for n in language_id.ORDERS:
            for i in range(len(chars) - n + 1):
                if n == 1 and chars[i] == " ":
                    continue
                h = 0
                for c in chars[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c) + 1) & mask
                out.append(((h * 0x9E3779B97F4A7C15) & mask) >> (64 - language_id.BUCKETS.bit_length() + 1))
        return out

    counts, prior = defaultdict(Counter), Counter()
    for _, t, lang in docs:
        if lang is not None:
            counts[lang].update(grams(t))
            prior[lang] += 1
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    langs, model = language_id.train(frame)
    assert langs == ["de", "en", "fr", "xx"]
    tests = ["das Haus", "the", "maison", "...", None, "x"]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), langs, model).collect()}
    for k, t in enumerate(tests):
        if not any(c.isalpha() for c in t or ""):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        logs = {}
        for lang in langs:
            total = sum(counts[lang].values()) + 0.5 * language_id.BUCKETS
            logs[lang] = math.log(prior[lang] / sum(prior.values())) + sum(math.log((counts[lang][b] + 0.5) / total) for b in grams(t))
        best = max(logs, key=logs.get)
        assert got[k].lang_pred == best and math.isclose(got[k].score, 1 / sum(math.exp(x - logs[best]) for x in logs.values()), rel_tol=1e-9)


def test_language_id_learns_all_languages(spark):
    rows = [(k, f"{chr(0x4E00 + k)} {chr(0x4E00 + k)}", f"l{k:03}") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, model = language_id.train(frame)
    assert len(langs) == 300
    got = language_id.predict(frame, langs, model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id:03}" for r in got) > 290


def test_language_id_on_held_out_rows(spark):
    sf = f"{DATA}/sf0.01"
    got = language_id.query(spark, sf).where("held_out").join(table(spark, "documents", sf).select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_toxicity_on_held_out_rows(spark):
    sf = f"{DATA}/sf0.1"
    got = toxicity.query(spark, sf).where("held_out").join(table(spark, "labels", sf), "doc_id").where("toxic is not null").toPandas()
    yes, no = (got.score[got.toxic == k].to_numpy() for k in (1, 0))
    auc = np.mean(np.searchsorted(np.sort(no), yes, "left") + np.searchsorted(np.sort(no), yes, "right")) / 2 / len(no)
    assert auc > 0.9
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def fitted(positive, unlabelled, prior, steps=toxicity.STEPS):
    in_p, in_u = (np.bincount(np.concatenate(x), minlength=7_000) for x in (positive, unlabelled))
    keep = np.flatnonzero(in_p + in_u > 0)
    rank = np.full(7_000, -1, np.int32)
    rank[keep] = np.arange(len(keep))
    bags = [[r[r >= 0] for r in (np.sort(rank[x]) for x in side)] for side in (positive, unlabelled)]
    w = np.zeros(7_000)
    w[keep], b = toxicity.fit(*bags, in_p[keep], in_u[keep], prior, steps)
    return w, b


def test_toxicity_of_words_in_one_percent_of_positives():
    """Every toxic word stands in 1 % of the positives and in no clean document; held-out documents have one of them each."""
    rng = np.random.default_rng(11)
    plain = lambda: rng.choice(5_000, 40, replace=False)
    rude = lambda k: np.append(plain(), 6_000 + k % 100)
    positive, unlabelled = [rude(k) for k in range(3_000)], [rude(k // 10) if k % 10 == 0 else plain() for k in range(6_000)]
    w, b = fitted(positive, unlabelled, 0.1)
    assert (w[6_000:6_100] > 0).all()
    toxic, clean = (np.array([w[x].sum() + b for x in xs]) for xs in ([rude(k) for k in range(500)], [plain() for _ in range(500)]))
    assert np.mean(toxic[:, None] > clean) > 0.9
    assert np.mean(toxic >= 0) > 0.9 and np.mean(clean >= 0) < 0.03


def loop_risk(z, n_p, prior):
    """Kiryo's non-negative risk and the gradient of the part that is stepped along, a document at a time."""
    n_u = len(z) - n_p
    positive = sum(math.log1p(math.exp(-x)) for x in z[:n_p]) / n_p * prior
    negative = sum(math.log1p(math.exp(x)) for x in z[n_p:]) / n_u - prior * sum(math.log1p(math.exp(x)) for x in z[:n_p]) / n_p
    grad = []
    for i, x in enumerate(z):
        p = 1 / (1 + math.exp(-x))
        g_neg = -prior * p / n_p if i < n_p else p / n_u
        g_pos = prior * (p - 1) / n_p if i < n_p else 0.0
        grad.append(g_pos + g_neg if negative >= 0 else -g_neg)
    return positive, negative, grad


def test_toxicity_steps_are_those_of_plain_loops(monkeypatch):
    """fit() against loops over documents and words: risk, gradient, Adam's steps and the cut by the prior."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(toxicity, "PART", 20)
    bags = [np.unique(rng.integers(0, 30, rng.integers(0, 9))).astype(np.int32) for _ in range(60)]
    p, u, prior = bags[:20], bags[20:], 0.2
    in_p, in_u = (np.bincount(np.concatenate(x), minlength=30) for x in (p, u))
    w, b = toxicity.fit(p, u, in_p, in_u, prior, 12)
    value = [((x - 20 * y / 40) ** 2 / (20 * y / 40 + 1)) for x, y in zip(in_p, in_u, strict=True)]
    value = [s / (toxicity.SURE**2 + s) / math.sqrt(math.log1p(x + y) + 1) for s, x, y in zip(value, in_p, in_u, strict=True)]
    v, m1, m2, bias, mb, vb, signs = [0.0] * 30, [0.0] * 30, [0.0] * 30, math.log(prior / (1 - prior)), 0.0, 0.0, set()
    for step in range(1, 13):
        z = [sum(v[k] * value[k] for k in x) + bias for x in bags]
        _, negative, g = loop_risk(z, 20, prior)
        signs.add(negative >= 0)
        for k in range(30):
            d = value[k] * sum(g[i] for i, x in enumerate(bags) if k in x) + toxicity.DECAY * v[k]
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * d, 0.999 * m2[k] + 0.001 * d * d
            v[k] -= toxicity.RATE * (m1[k] / (1 - 0.9**step)) / (math.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        d = sum(g)
        mb, vb = 0.9 * mb + 0.1 * d, 0.999 * vb + 0.001 * d * d
        bias -= toxicity.RATE * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(w, [a * c for a, c in zip(v, value, strict=True)], atol=1e-9)
    assert math.isclose(b, -np.quantile([sum(w[k] for k in x) for x in u], 0.8), abs_tol=1e-9)
    for z in (rng.normal(0, 1, 60), np.r_[np.full(20, 4.0), np.full(40, -4.0)]):
        got, want = toxicity.risk(z, 20, prior), loop_risk(z.tolist(), 20, prior)
        assert math.isclose(got[0], want[0]) and math.isclose(got[1], want[1]) and np.allclose(got[2], want[2])
    assert toxicity.risk(np.r_[np.full(20, 4.0), np.full(40, -4.0)], 20, prior)[1] < 0


def test_toxicity_draws(spark, monkeypatch):
    """Most rows have no id and are drawn by their texts; words that clean rows alone have lower a score; a bound of words thins the bags."""
    rude = [(i, f"you rude{i % 7} nasty{i % 5} one number{i}") for i in range(0, 400, 4)]
    clean = [(None if i % 2 else i, f"a mild{i % 7} kind{i % 5} word number{i}") for i in range(1_000, 3_000)]
    docs = spark.createDataFrame(rude + clean, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in rude] + [(i, 0) for i, _ in clean if i], "doc_id long, toxic int")
    w, b = toxicity.train(docs, labels)
    asked = spark.createDataFrame([(1, "nasty1"), (2, ""), (3, "nasty1 mild1 kind2")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(asked, w, b).collect()}
    assert s[1] > s[3] and s[1] > s[2]
    again, _ = toxicity.train(docs, labels)
    assert (again == w).all()
    monkeypatch.setattr(toxicity, "MOST_UNLABELLED", 1_100)
    drawn = np.count_nonzero(toxicity.train(docs, labels)[0])
    monkeypatch.setattr(toxicity, "MOST_WORDS", 2_000)
    thinned = np.count_nonzero(toxicity.train(docs, labels)[0])
    assert 0 < thinned < drawn < np.count_nonzero(w)


def test_toxicity_bags_hold_all_words():
    (batch,) = toxicity._bags(iter([pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{x}" for x in range(60_000))]), pa.array([True])], ["text", "positive"])]))
    assert len(batch.column(1)[0].as_py()) // 4 > 50_000


def brute_perplexity(trusted, docs):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    c = Counter()
    for t in trusted:
        if w := words(t):
            c.update(zip(["<s>", *w], [*w, "</s>"], strict=True))
    before, follow, total = Counter(), defaultdict(Counter), Counter()
    for (v, w), n in c.items():
        before[w] += 1
        follow[v][min(n, 3)] += 1
        total[v] += n
    of = lambda counts: quality.discounts(np.array([0, *[sum(n == k for n in counts) for k in (1, 2, 3, 4)]]))
    d, e = of(c.values()), of(before.values())
    n, size = sum(before.values()), len(before)
    rest = sum(e[min(x, 3) - 1] for x in before.values()) / n
    u = {w: (before[w] - e[min(before[w], 3) - 1]) / n + rest / (size + 1) for w in before}
    unknown = rest / (size + 1)
    assert math.isclose(sum(u.values()) + unknown, 1)
    g = {v: sum(d[k - 1] * follow[v][k] for k in (1, 2, 3)) / total[v] for v in total}
    assert all(math.isclose(sum((k - d[min(k, 3) - 1]) / total[v] for (x, _), k in c.items() if x == v) + g[v], 1) for v in list(total)[:50])
    out = {}
    for i, t in docs:
        if w := words(t):
            s = 0.0
            for a, b in zip(["<s>", *w], [*w, "</s>"], strict=True):
                k = c[a, b]
                s += math.log(g.get(a, 1.0) * u.get(b, unknown) + ((k - d[min(k, 3) - 1]) / total[a] if k else 0.0))
            out[i] = math.exp(-s / (len(w) + 1))
    return out


def test_quality_is_kneser_ney(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    trusted = docs.join(labels.where("quality > 0"), "doc_id", "left_semi")
    want = brute_perplexity([r.text for r in trusted.collect()], [(r.doc_id, r.text) for r in docs.collect()])
    for head in (quality.HEAD, 50, 0):
        got = {r.doc_id: r for r in quality.classify(docs, trusted, head=head).collect()}
        assert {k for k, r in got.items() if r.perplexity is not None} == set(want)
        assert all(math.isclose(got[k].perplexity, p, rel_tol=1e-3) for k, p in want.items())
        by = defaultdict(list)
        for k, p in want.items():
            by[got[k].lang].append(got[k].kept)
        assert all(0.9 <= np.mean(x) <= 0.9 + 1 / len(x) + 0.05 for x in by.values())


@pytest.mark.parametrize("head", [quality.HEAD, 50])
def test_quality_by_parts_is_the_whole_model(spark, tmp_path, monkeypatch, head):
    """Each part counts and scores its own contexts; rows that repeat a text, without words or without text are scored each. Of all tables the sums alone stay on disk."""
    docs = table(spark, "documents").select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.where("doc_id < 9")).unionByName(spark.createDataFrame([(-1, None, "en"), (-2, " ", None), (-3, "x", None)], docs.schema)).repartition(5)
    trusted = docs.where("doc_id % 3 = 0")
    monkeypatch.setattr(shared, "folder", lambda _: str(tmp_path))
    want, got = (sorted(map(tuple, quality.classify(docs, trusted, head=head, parts=k).collect()), key=str) for k in (1, 3))
    assert got == want and len(got) == docs.count()
    assert sorted(x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()) == ["lm-part-sums", "lm-sums"]


def test_freed_tables_leave_no_shuffle(spark):
    """Of the two tables written through a shuffle, the freed one's files go."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.sc().conf()

    def files():
        return {f for d in jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(conf) for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    left = []
    for write in (shared.written, shared.freed):
        before = files()
        rows = write(spark.range(5_000).repartition(7, "id"), "rows")
        deadline = time.time() + 10
        while files() - before and write is shared.freed and time.time() < deadline:
            time.sleep(0.2)
        left.append(len(files() - before))
        assert rows.distinct().count() == 5_000
    assert left[0] > 0 and left[1] == 0


def test_quality_of_a_model_is_a_distribution(spark):
    model = quality.train(spark.createDataFrame([("a b a b a c b a b a b b a c a b",)] * 3, "text string"))
    key = {r.key: r.delta for r in model.table.collect()}
    words = {w: int(quality.T.words(np.frombuffer(w.encode(), np.uint8), np.array([0, 1]))[3][0][0]) for w in "abc"}
    docs = spark.createDataFrame([(k, f"a {w}") for k, w in enumerate("abc")], "doc_id long, text string")
    assert len(key) > 6 and len(set(words.values())) == 3
    assert all(r.logp < 0 for r in quality.log_probabilities(docs, model, extra=("doc_id",)).collect())


@pytest.mark.parametrize("tile", [jaccard_join.TILE, 4])
def test_jaccard_join_finds_all_links(spark, monkeypatch, tile):
    """With small tiles groups of copies are connected by stars, and blocks span pairs of tiles."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rng = np.random.default_rng(3)
    texts = [f"{TM} a a b", f"{MT} a a b", TM, MT]
    for g in range(60):
        base = rng.integers(0, 300, rng.integers(3, 120))
        for _ in range(rng.integers(1, 9)):
            t = base.copy()
            t[rng.random(len(t)) < rng.choice([0, 0.01, 0.03, 0.1])] = rng.integers(0, 300)
            texts.append(" ".join(f"t{x}" for x in t))
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    got = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))
    assert {r.doc_id: r.n_shingles for r in got} == {k: len(s) for k, s in enumerate(sets)}


def test_token_output_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_output.default_tokenizer())
    docs = sorted((r.doc_id, r.text) for r in table(spark, "documents").collect())
    docs += [(10**6, None), (10**6 + 1, "  two  spaces \n\n and\ttabs   <|endoftext|> x "), (10**6 + 2, ""), (10**6 + 3, "one <|endoftext|> two"), (10**6 + 4, TM), (10**6 + 5, MT)]
    got = sorted(token_output.tokenised(spark.createDataFrame(docs, "doc_id long, text string"), token_output.default_tokenizer()).collect())
    start = 0
    for (d, text), r in zip(docs, got, strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoder_of_letters_alone_gives_the_librarys_ids():
    """Words of letters go to the library without its pattern; whatever looks like them but isn't, with it."""
    from tokenizers import Tokenizer

    path, rng = token_output.default_tokenizer(), random.Random(5)
    whole, encoder = Tokenizer.from_file(path), token_output.Encoder(path, most=3_000)
    plain = []
    library, encoder.plain = encoder.plain, type("", (), {"encode_batch_fast": lambda _, x, **kw: plain.extend(x) or library.encode_batch_fast(x, **kw)})()
    some = [" é", " ab", " ñé", "'re", "<|endoftext|>", " Ãb", " Ġa", " ×a", " a÷", *"abzABéÀÿß×÷œǆ٣3 9'’s.,\n\t\u00a0\u00ad\u0120-ж中"]
    for _ in range(20):
        texts = ["".join(rng.choices(some, k=rng.randrange(30))) for _ in range(200)]
        for lo, hi, data, at in quality.T.slices(pa.array(texts)):
            ids, to = encoder.encode(data, at)
            for k in range(lo, hi):
                assert ids[to[k - lo] : to[k - lo + 1]].tolist() == [*whole.encode(texts[k], add_special_tokens=False).ids, token_output.END_ID]
    words = {w for x in plain for w in x.split("Ġ")}
    assert {"ab", "Ã©", "Ã±Ã©"} <= words and not any(c in w for w in words for c in "3'.,-<")


def test_token_output_starts_of_repeated_ids(spark):
    """Rows of one id: each row's start is where its ids are in the files, and reruns agree."""
    docs = spark.createDataFrame([(7, f"text number {k} " * (k + 1)) for k in range(40)] + [(None, "of none"), (8, "last")], "doc_id long, text string")
    seen = []
    for _ in range(2):
        at = token_output.shared.path(spark, "tokens")
        token_output.write_tokens(docs.repartition(8), at, token_output.default_tokenizer())
        rows = token_output.read_tokens(spark, at).orderBy("part", "row").collect()
        every = [i for r in rows for i in r.ids]
        index = sorted(token_output.token_index(spark, at).collect(), key=lambda r: r.start)
        for r in index:
            assert zlib.crc32(np.array(every[r.start : r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32
        assert [r.doc_id for r in index] == [None, *[7] * 40, 8] and index[-1].start + index[-1].n_tokens == len(every)
        seen.append([(r.doc_id, r.start, r.ids_crc32) for r in index])
    assert seen[0] == seen[1]


def test_token_output_is_read_by_stripes_and_ids(spark):
    import glob

    from pyarrow import orc

    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(k)).cast("string"), 256) for k in range(2)]).alias("text"))
    at = token_output.shared.path(spark, "tokens")
    token_output.write_tokens(docs.coalesce(1), at, token_output.default_tokenizer(), stripe=1 << 16, stride=1000)
    files = glob.glob(f"{at.removeprefix('file://')}/*.orc")
    assert sum(orc.ORCFile(f).nstripes for f in files) > len(files)
    some = token_output.read_tokens(spark, at, 1_000, 1_009)
    assert "GreaterThanOrEqual(doc_id,1000)" in some._jdf.queryExecution().toString()
    assert [r.doc_id for r in some.orderBy("doc_id").collect()] == list(range(1_000, 1_010))
    # The scan itself gives fewer rows than the files have: row groups without the ids are skipped.
    scans = some._jdf.queryExecution().executedPlan().collectLeaves()
    some._jdf.queryExecution().toRdd().count()
    assert 10 <= scans.head().metrics().get("numOutputRows").get().value() < 12_000


def test_token_output_of_another_kind_of_tokenizer(spark):
    """A tokenizer that isn't byte-level gets whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, docs = Tokenizer.from_file(path), [(1, "Some  Words, and more\nof them."), (2, "<|endoftext|> it's"), (3, "Some  Words, and more\nof them.")]
    got = sorted(token_output.tokenised(spark.createDataFrame(docs, "doc_id long, text string"), path).collect())
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in docs]


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = table(spark, "documents")
    seen = [docs]
    for _, stage in p.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).cache())
        assert seen[-1].columns == p.COLUMNS
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    components = jaccard_join.jaccard_join(seen[1]).collect()
    assert ids[2] == {r.component_id for r in components}
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    assert ids[2] - ids[3] == {m[0] for m in brute_matches([(r.doc_id, r.text) for r in seen[2].collect()], items)}
    assert seen[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    out = p.STAGES[-1][1](spark, seen[4], SF)
    assert out.count() == seen[4].count()


def test_pipeline_near_copies_by_five_word_shingles(spark):
    """Against a brute force of 5-word shingles at 0.8: scattered edits, inserted, cut and appended stretches about the threshold."""
    import corpus_pipeline as p

    rng = np.random.default_rng(5)
    texts = []
    for g in range(40):
        base = [f"g{g}w{x}" for x in rng.integers(0, 1000, rng.integers(60, 200))]
        at, k, new = len(base) // 3, int(len(base) * rng.choice([0.1, 0.15, 0.18, 0.22])), [f"new{x}" for x in rng.integers(0, 1000, len(base))]
        edited = list(base)
        for x in rng.choice(len(base), max(1, round(len(base) * rng.choice([0.015, 0.021, 0.03]))), replace=False):
            edited[x] = "edited"
        texts += [" ".join(x) for x in (base, edited, base[:at] + new[:k] + base[at:], base[:at] + base[at + k :], base + new[:k])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in p.one_of_near_copies(spark, docs, SF).collect()} == set(label)
    assert len(set(label)) < len({r.component_id for r in jaccard_join.jaccard_join(docs).collect()})


def test_encoder_pieces_give_the_ids_of_whole_texts():
    """Texts of marks, white space of all kinds, contractions and letters, with a memory so small that pieces are forgotten and met again."""
    e = token_output.Encoder(token_output.default_tokenizer(), 1000)
    some = random.Random(1)
    parts = [*"ab Zé  \n\n\t.,!?'1 9-  　’漢\u0085\x1c\r    ", "'s", "'ll ", "<|endoftext|>", "x\ny", "the ", ". ", " of"]
    for _ in range(12):
        texts = ["".join(some.choices(parts, k=some.choice([0, 1, 2, 3, 5, 8, 20, 60]))) for _ in range(400)]
        (_, _, data, at), *_ = token_output.slices(pa.array(texts, pa.string()), 1 << 30)
        ids, to = e.encode(data, at)
        want = [[*x.ids, 2] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(to[:-1], to[1:], strict=True)] == want


def test_encoder_of_bytes_that_are_not_text():
    """Bytes that aren't UTF-8 become U+FFFD, also between pieces that are learned in one call."""
    e = token_output.Encoder(token_output.default_tokenizer())
    texts = [b"one two three", b" a\xff b \xc2", b"\x85 end", b"", b" one four five", " \ufffd is\ufffd six".encode()]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(x) for x in texts])]
    for _ in range(2):
        ids, to = e.encode(data, at)
        want = [[*x.ids, 2] for x in e.tokenizer.encode_batch([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(to[:-1], to[1:], strict=True)] == want


def test_groups_of_elements_that_the_same_classes_share_are_one_task(spark):
    """Near copies are sent once, not once an element; classes without another near enough in size aren't sent."""
    rows = [(e, c, n) for e in range(50) for c, n in ((1, 100), (2, 110), (3, 400))] + [(e, c, 100) for e in range(60, 70) for c in (1, 2, 4)] + [(90, 5, 10), (90, 6, 100)]
    got = jaccard_join._groups(spark.createDataFrame(rows, "element long, class_id long, n int"), 80).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.key, []).append((r.class_id, r.n))
    assert sorted(map(sorted, groups.values())) == [[(1, 100), (2, 100), (4, 100)], [(1, 100), (2, 110)]]


def test_links_of_a_tile_are_stars():
    ids, chain = np.array([7, 3, 9, 1, 5]), {0: [1], 1: [2], 2: [], 3: [4]}
    assert sorted(jaccard_join._forest(ids, np.arange(5), lambda i, label: chain[i])) == [(1, 5), (3, 7), (3, 9)]
    # What a label joins already needs no link.
    assert jaccard_join._forest(ids, np.array([0, 0, 1, 2, 2]), lambda i, label: chain[i]) == [(3, 9)]


def test_substring_factors(spark):
    """Factors hold the words of their references, are as long as they can be, and cover what the SQL's rule removes; crafted words don't collide."""
    rng = np.random.default_rng(4)
    word = lambda k: f"w{k}"
    base = [[word(x) for x in rng.integers(0, 10_000, 200)] for _ in range(6)]
    docs = [list(b) for b in base]
    for _ in range(40):
        parts = []
        for _ in range(rng.integers(1, 5)):
            b = base[rng.integers(6)]
            lo = int(rng.integers(0, 150))
            parts += b[lo : lo + int(rng.integers(5, 60))] + [word(x) for x in rng.integers(10_000, 20_000, rng.integers(0, 4))]
        docs.append(parts)
    docs += [[*base[0][:19], TM], [*base[0][:19], MT]]
    got = substring_dedup.factors(spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")).collect()
    assert got and all(docs[f.place][f.start : f.start + f.n_words] == docs[f.ref_place][f.ref_start : f.ref_start + f.n_words] and f.n_words >= 20 for f in got)
    assert all((f.ref_place, f.ref_start) < (f.place, f.start) for f in got)
    first, want, cover = {}, set(), set()
    for k, d in enumerate(docs):
        for p in range(len(d) - 19):
            ref = first.setdefault(tuple(d[p : p + 20]), (k, p))
            if ref != (k, p):
                want.update((k, x) for x in range(p, p + 20))
    for f in got:
        cover.update((f.place, x) for x in range(f.start, f.start + f.n_words))
    assert cover == want
    # Greedy: no factor is followed by one of the same reference at the same distance.
    ends = {(f.place, f.start + f.n_words - 19, f.ref_place, f.ref_start + f.n_words - 19) for f in got}
    assert not ends & {(f.place, f.start, f.ref_place, f.ref_start) for f in got}
    kept = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")).collect()}
    assert kept == {k: sum((k, x) in want for x in range(len(d))) for k, d in enumerate(docs)} and kept[len(docs) - 1] == 0


def test_line_runs(spark):
    """By hand: a long line alone, short lines together, a short text, runs extended both ways; short lines alone stay."""
    long = "this one line has more than ten words in it all alone"
    a = f"{long}\nshort one\nshort two\na third short line here\nfourth of them now\nend"
    docs = [(1, a), (2, f"other\n{long}\nother end"), (3, f"x\n short  one\nshort two\na third short line here\nfourth of them now\ny"), (4, "tiny text"), (5, "tiny text"), (6, "short one\nunlike"), (7, a), (8, f"{TM} a b c d e f g h i j"), (9, f"{MT} a b c d e f g h i j")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in line_dedup.line_dedup(frame).collect()}
    assert got == {1: a, 2: "other\nother end", 3: "x\ny", 4: "tiny text", 5: "", 6: "short one\nunlike", 7: "", 8: docs[7][1], 9: docs[8][1]}
    runs = {(r.place, r.first, r.last, r.ref_place, r.ref_first) for r in line_dedup.repeated_runs(frame).collect()}
    assert {(2, 1, 1, 1, 0), (3, 1, 4, 1, 1), (7, 0, 5, 1, 0), (5, 0, 0, 4, 0)} == runs
