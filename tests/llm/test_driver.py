"""What the driver holds: rounds over little, and the fit of the quality classifier."""

import random
import tracemalloc

import pytest

from millrace.llm import _components, quality


def _plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _found(spark, edges):
    return {r["node"]: r["component"] for r in _components.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(4)).collect()}


def test_few_edges_take_one_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(_components, "written", lambda df, f=_components.written: rounds.append(1) or f(df))
    edges = [(i * 7919 % 400, (i + 1) * 7919 % 400) for i in range(399)]
    assert _found(spark, edges) == _plain(edges)
    assert len(rounds) <= 3


@pytest.mark.parametrize("few", [0, 40, 1 << 14])
def test_rounds_and_the_last_one_agree_with_plain_components(spark, monkeypatch, few):
    monkeypatch.setattr(_components, "FEW", few)
    r = random.Random(5)
    edges = [(r.randrange(-200, 200), r.randrange(-200, 200)) for _ in range(170)] + [(1000, 1000 + i) for i in range(50)] + [(None, 3), (4, None), (5, 5)]
    assert _found(spark, edges) == _plain(edges)
    assert _found(spark, [(7, 7), (None, 1)]) == {}


def test_the_fit_holds_two_arrays_of_the_models_size():
    tracemalloc.start()
    try:
        quality.ftrl([])
        assert tracemalloc.get_traced_memory()[1] < 28 << 20
    finally:
        tracemalloc.stop()
