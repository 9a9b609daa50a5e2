import random

import pytest

from tickloom.llm import graph


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components_against_a_loop(spark, kind):
    """Chains in the order of their ids, backwards and shuffled, hubs above and below their leaves, links that repeat and that lead nowhere."""
    rng = random.Random(3)
    shuffled = rng.sample(range(1_000, 1_200), 200)
    links = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, 5), (7, 8), (8, 7), (7, 8)],
        "path": [(i, i + 1) for i in range(150)] + [(i + 1, i) for i in range(500, 650)] + list(zip(shuffled, shuffled[1:])),
        "star": [(0, i) for i in range(1, 80)] + [(999, i) for i in range(100, 180)] + [(-4, -3), (-3, 2_000)],
        "none": [],
    }[kind]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        if a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}
