"""Components of random graphs, contracted first or not, against a plain search."""

import random

import numpy as np
import pytest

from tidemark.operators import conflicts
from tidemark.operators.components import components, contracted, stars


def searched(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in out:
                out[n] = start
                todo += near[n]
    return out


def graph(seed, nodes, edges):
    rng = random.Random(seed)
    return [(rng.randrange(nodes) - nodes // 2, rng.randrange(nodes) - nodes // 2) for _ in range(edges)]


@pytest.mark.parametrize("edges", [graph(1, 60, 40), graph(2, 200, 150), graph(3, 40, 400), [(i, i + 1) for i in range(300)], [(0, i) for i in range(300)], [(5, 5)], []])
def test_stars(edges):
    ends = [np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1)]
    assert dict(zip(*map(np.ndarray.tolist, stars(*ends)), strict=True)) == {n: r for n, r in searched(edges).items() if n != r}


@pytest.mark.parametrize("at_once", [5, 1_000_000])
def test_contracted_edges_have_the_same_components(spark, at_once):
    edges = graph(4, 150, 110) + [(1000 + i, 1001 + i) for i in range(60)] + [(2**62, -(2**62)), (7, 7)]
    few = contracted(spark.createDataFrame(edges, "a bigint, b bigint"), at_once)
    assert {r.node: r.root for r in components(few).collect()} == searched([e for e in edges if e[0] != e[1]])


def test_groups_with_lone_nodes(spark):
    edges = graph(6, 90, 60) + [(500, 500), (501, 501), (501, 502), (501, 502)]
    assert {r.who: r.root for r in conflicts.conflict_components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").withColumnRenamed("node", "who").collect()} == searched(edges)
    assert conflicts.conflict_components(spark.createDataFrame([], "x bigint, y bigint"), "x", "y").collect() == []
