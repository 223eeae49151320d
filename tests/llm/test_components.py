import random

import pytest

from boundwell.llm import components as C
from tests.llm import brute


@pytest.mark.parametrize("local", [0, 100_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(C, "LOCAL_EDGES", local)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(7, 7), (3, 2), (2, 3)]
    union = brute.Union({x for e in edges for x in e})
    for a, b in edges:
        union.join(a, b)
    got = C.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()
    assert {r.node: r.component for r in got} == {x: union.find(x) for x in union.up if union.find(x) != x}
    assert len(got) == len({r.node for r in got})


def test_no_edges(spark):
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0
