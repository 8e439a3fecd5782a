import random

import pytest

from scanloom.llm.graph import components


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    ids = list(range(120))
    rng.shuffle(ids)
    edges = {"chain": list(zip(ids, ids[1:])), "star": [(ids[0], x) for x in ids[1:]], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(130)], "loops": [(1, 1), (2, 3), (3, 2)], "none": []}[kind]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x or any(find(y) == x for y in root if y != x)}
