"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from tickloom.llm import decontamination, exact_dedup, jaccard_join, language_id, line_dedup, mixing, quality, substring_dedup, token_output, toxicity

COMMON = " ".join(f"word{i} thing{i % 7}" for i in range(40))
LONG = " ".join(f"w{i}" for i in range(150_000))
ROWS = [
    (1, COMMON, "en", "a"), (2, COMMON, "en", "a"), (2, COMMON, "en", "a"), (3, None, None, None), (4, "", "de", "b"), (5, " \t\n ", "de", None),
    (6, LONG, "fr", "a"), (None, "an orphan text of no id", "en", "b"), (7, "kurz", "de", "b"), (8, "12 !! 34", "en", "b"), (9, "Ünïcödé çà et là   \U0001f600", "fr", "b"),
    (10, "l1 one is here\nl2 two\nl3 three\nl4 four or more", "en", "a"), (11, "l0\nl1 one is here\nl2  two\n l3 three \nl4 four or more\nl5", "en", "a"),
]
CLASHES = ["n", "key", "tie", "size", "word", "hash", "digest", "block", "component", "score", "body", "ask", "pick", "weight", "doc_ids", "l_id", "_rid", "target", "file", "start"]
ITEMS = [(1, COMMON), (2, None), (3, ""), (4, "too few")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return d.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (6, None, None), (None, 1, 1), (10, 1, 1)], "doc_id long, quality int, toxic int")


def all_of(spark, docs, labels):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    tokens = token_output.default_tokenizer()
    langs, m = language_id.train(docs)
    w, b = toxicity.train(docs, labels)
    return {
        "decontamination": decontamination.matches(docs, items), "language": language_id.predict(docs, langs, m, ("source", "n")), "mixing": mixing.mix(docs, mixing.label_weights(labels)),
        "substring": substring_dedup.substring_dedup(docs), "line": line_dedup.line_dedup(docs), "jaccard": jaccard_join.jaccard_join(docs), "toxicity": toxicity.score(docs, w, b, ("lang", "n")),
        "quality": quality.classify(docs, docs.where("doc_id < 7")), "exact": exact_dedup.exact_dedup(docs), "tokens": token_output.tokenised(docs, tokens),
    }


def test_messy_rows(spark, docs, labels):
    out = {k: x.collect() for k, x in all_of(spark, docs, labels).items()}
    for k in set(out) - {"decontamination"}:
        assert len(out[k]) == len(ROWS), k
    by = {k: {r["doc_id"]: r for r in x} for k, x in out.items()}
    assert {r.doc_id for r in out["decontamination"]} == {1, 2}
    assert by["language"][3].lang_pred == by["language"][8].lang_pred == "und" and by["language"][3].score == 0
    assert by["jaccard"][2].component_id == 1 and by["jaccard"][3].component_id == 3 and by["jaccard"][4].n_shingles == 0
    assert by["jaccard"][6].n_shingles == 150_000 - 3
    assert by["substring"][2].n_removed == 80 and by["substring"][1].n_removed == 0 and by["substring"][3].n_words == 0 and by["substring"][6].n_words == 150_000
    assert by["jaccard"][None].component_id is None and by["substring"][None].n_removed == 0 and by["line"][None].n_lines == 1
    assert by["line"][11].kept == "l0\nl5" and by["line"][10].n_removed == 0
    assert by["exact"][2].keep_id == 1 and by["exact"][2].group_size == 3 and by["exact"][3].keep_id == 3 and by["exact"][4].keep_id == 3
    assert by["exact"][5].keep_id == 5
    assert not by["quality"][3].kept and by["quality"][3].perplexity is None and by["quality"][1].kept
    assert by["tokens"][3].n_tokens == 1 and by["tokens"][None].start == 0
    assert by["mixing"][3].size == 0 and all(r.taken <= 2 * r.size for r in out["mixing"])
    assert all(0 <= r.score <= 1 for r in out["toxicity"])


def test_empty_tables(spark, docs, labels):
    for k, x in all_of(spark, docs.limit(0), labels.limit(0)).items():
        assert x.collect() == [], k


def test_pipeline_on_messy_rows(spark, docs, labels, tmp_path):
    import corpus_pipeline

    documents = docs.withColumn("n_chars", F.length("text").cast("long"))
    for name, rows in (("some", documents), ("none", documents.limit(0))):
        at = str(tmp_path / name)
        rows.write.parquet(f"{at}/documents.parquet")
        labels.where("toxic is null or toxic = 0").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out = corpus_pipeline.run(spark, at).collect()
        assert bool(out) == (name == "some")


def test_pipeline_stages_by_rows(spark, tmp_path):
    """Rows without ids and rows that repeat ids: what each stage keeps, by id and text."""
    import corpus_pipeline

    item = "the quick brown fox jumps over the lazy dog and runs away from here at last"
    other = " ".join(f"other{k}" for k in range(30))
    texts = [(1, COMMON), (1, other), (1, other), (2, COMMON), (None, COMMON), (None, f"once {item} again"), (None, "a text of its own that nobody else has at all"), (None, None), (None, None), (3, ""), (None, "and this one twice here without any id"), (None, "and this one twice here without any id")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    at = str(tmp_path)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    rows = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    assert rows(corpus_pipeline.drop_toxic(spark, docs, at)) == rows(docs)
    # The texts of id 1 are judged apart: the one that 2 and a row without an id copy stays for them, of the other one of its two rows.
    near = rows(corpus_pipeline.one_of_near_copies(spark, docs, at))
    assert [x for x in near if x[1] in (COMMON, other)] == sorted([(1, COMMON), (1, other)], key=str)
    rest = [(None, f"once {item} again"), (None, "a text of its own that nobody else has at all"), (None, None), (None, None), (3, ""), (None, "and this one twice here without any id")]
    assert [x for x in near if x[1] not in (COMMON, other)] == sorted(rest, key=str)
    clean = rows(corpus_pipeline.drop_contaminated(spark, docs, at))
    assert clean == sorted([x for x in texts if item not in (x[1] or "")], key=str)
    # An item of one common word is reported as short and drops nothing; a text that quotes an item doesn't take another of its id along.
    more = str(tmp_path / "more")
    spark.createDataFrame([(1, item), (2, "that")], "item_id long, text string").write.parquet(f"{more}/benchmark.parquet")
    quoting = docs.unionByName(spark.createDataFrame([(1, f"look {item}", "en", "a", 80)], docs.schema))
    assert rows(corpus_pipeline.drop_contaminated(spark, quoting, more)) == clean
    found = decontamination.matches(quoting, spark.read.parquet(f"{more}/benchmark.parquet")).collect()
    assert {(r.item_id, r.short) for r in found} == {(1, False), (2, True)}
    # One source alone: its target is one and a half of its words, so each row with words comes once or twice.
    mixed = rows(corpus_pipeline.to_target_weights(spark, docs, at))
    assert {x: mixed.count(x) >= texts.count(x) for x in texts if (x[1] or "").strip()} == {x: True for x in texts if (x[1] or "").strip()}
    assert all(mixed.count(x) <= 2 * texts.count(x) for x in mixed)
