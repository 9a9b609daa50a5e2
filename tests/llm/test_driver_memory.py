"""Queries of the near-copy join stay small: the driver holds the plan, the stages and the tasks of each."""

import random

import pytest

from tickloom.llm import jaccard_join, shared


@pytest.mark.parametrize("tile", [jaccard_join.TILE, 4])
def test_near_copy_join_is_written_in_small_queries(spark, monkeypatch, tile):
    rng = random.Random(3)
    base = [f"w{rng.randrange(200)}" for _ in range(60)]
    texts = []
    for _ in range(24):
        words = base.copy()
        for k in rng.sample(range(60), 1):
            words[k] = f"x{rng.randrange(50)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randrange(300)}" for _ in range(40)) for _ in range(10)]
    links, exchanges, write = [], [], shared.written

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]

    def written(df, name, **options):
        exchanges.append((sum(line.split("(")[0].endswith("- Exchange hashpartitioning") for line in plan(df).splitlines()), name))
        return write(df, name, **options)

    components = jaccard_join.graph.components
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(shared, "written", written)
    monkeypatch.setattr(jaccard_join.graph, "components", lambda df: links.append(plan(df)) or components(df))
    jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    # components() reads its links twice: tables, or a task would find them twice.
    assert links and not any("MapInArrow" in x or "Exchange" in x for x in links)
    assert max(exchanges)[0] <= 9, sorted(exchanges)[-5:]
