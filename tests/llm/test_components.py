"""Connected components against a plain union-find."""

import random

import pytest

from tallyspark.llm import common


def brute(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        for x in (a, b):
            root.setdefault(x, x)
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def shapes():
    rng = random.Random(4)
    path = list(range(300))
    rng.shuffle(path)
    return {
        "path": list(zip(path, path[1:])),
        "star around a large node": [(1000, k) for k in range(500)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(330)],
        "loops, nulls, repeats": [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (5, 4)],
        "empty": [],
    }


@pytest.mark.parametrize("name", shapes())
@pytest.mark.parametrize("nodes", [1_000_000, 5])
def test_components(spark, monkeypatch, name, nodes):
    monkeypatch.setattr(common, "FOREST_NODES", nodes)
    edges = shapes()[name]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = common.connected_components(df).collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_components_of_binary_nodes(spark):
    edges = [(b"b", b"a"), (b"c", b"b"), (b"z", b"y")]
    got = common.connected_components(spark.createDataFrame(edges, "a binary, b binary")).collect()
    assert {bytes(r.node): bytes(r.component) for r in got} == brute(edges)
