"""What chance alone brings together in the near-copy join neither meets nor becomes a block: blocks would grow with the square of the documents, and their texts go to each pair of tiles."""

import numpy as np

from tickloom.llm import jaccard_join, shared


def test_chance_makes_no_candidates(spark, monkeypatch):
    rng = np.random.default_rng(5)
    p = 1 / np.arange(1, 20_001) ** 1.35
    texts = [rng.choice(len(p), 250, p=p / p.sum()) for _ in range(500)]
    for k in range(0, 50, 5):
        copy = texts[k].copy()
        copy[rng.integers(250)] = 30_000 + k
        texts.append(copy)
    texts = [" ".join(f"w{x}" for x in t) for t in texts]
    seen, write = [], shared.written

    def written(df, name, **options):
        table = write(df, name, **options)
        if name in ("element-members", "jaccard-candidates"):
            seen.append((name, table.count()))
        return table

    monkeypatch.setattr(shared, "written", written)
    got = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).collect()
    met = dict(seen)
    assert {r.doc_id: r.component_id for r in got} == {k: (k - 500) * 5 if k >= 500 else k for k in range(510)}
    # Ten pairs of copies: each shares no more than its prefixes, some 50 elements.
    assert met["element-members"] <= 2 * 10 * 60
    assert met["jaccard-candidates"] == 10
