import random

import numpy as np
import pytest

from gridloom.llm.components import match_groups, min_roots

SCHEMA = "pair_id long, l string, r string, p double, node string, root string, n int"


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, a, b, p, *_ in pairs:
        if a is not None and b is not None and a != b and p is not None and p >= 0.8:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {(x, find(x)) for x in parent}


def groups(spark, pairs, **kw):
    df = spark.createDataFrame(pairs, SCHEMA)
    return {(r.node_id, r.group_id) for r in match_groups(df, "l", "r", "p", 0.8, **kw).collect()}


@pytest.mark.parametrize("bound", [1_000_000, 40])
def test_shapes_against_brute_force(spark, bound):
    rnd = random.Random(2)
    node = lambda i: f"n{i:04d}"
    edges = [(i, i + 1) for i in range(200, 290)] + [(300, 300 + i) for i in range(1, 120)] + [(rnd.randrange(100), rnd.randrange(100)) for _ in range(60)] + [(500, 500)]
    pairs = [(k, node(a), node(b), 0.9, "x", "y", 1) if rnd.random() < 0.5 else (k, node(b), node(a), 0.8, "x", "y", 1) for k, (a, b) in enumerate(edges * 2)]
    pairs += [(0, "n0000", "n0299", 0.79, "x", "y", 1), (0, "n0001", "n0300", None, "x", "y", 1), (0, None, "n0001", 0.9, "x", "y", 1), (0, "n0002", None, 0.9, "x", "y", 1)]
    rnd.shuffle(pairs)
    assert groups(spark, pairs, max_edges=bound) == brute(pairs)


def test_thin_edges_go_by_star_steps(spark, monkeypatch):
    """No level counts as shrinking, so the first contraction hands over."""
    monkeypatch.setattr("gridloom.llm.components.SHRINK", -1)
    pairs = [(k, f"n{k % 97:03d}", f"n{(k * 7 + 1) % 97:03d}", 0.9, "x", "y", 1) for k in range(60)]
    assert groups(spark, pairs, max_edges=3) == brute(pairs)


def test_empty(spark):
    assert groups(spark, []) == set()
    assert groups(spark, [(1, "a", "a", 1.0, "x", "y", 1)]) == set()


def test_union_find_on_a_long_chain():
    a = np.arange(9_999)
    assert (min_roots(a + 1, a, 10_000) == 0).all()
    assert (min_roots(np.zeros(0, int), np.zeros(0, int), 3) == np.arange(3)).all()
