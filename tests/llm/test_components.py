import random

import pytest

import loam.llm.components as module
from loam.llm.components import components


@pytest.mark.parametrize("local", [0, 10**6])
def test_against_union_find(spark, monkeypatch, local):
    monkeypatch.setattr(module, "LOCAL_EDGES", local)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    want = {x: top(x) for x in list(root)}
    got = components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
