import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm.neighbours import Forest, nearest, usable_vectors

SCHEMA = "sql_id string, vector array<float>, is_probe boolean, id string, v int"


def clustered(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 12), dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.3 * rng.standard_normal((n, dim))).astype(np.float32)


def brute(ids, x, queries, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = u @ u[q]
        s[q] = -2
        out[ids[q]] = [ids[i] for i in sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:k]]
    return out


def test_recall_against_brute_force(spark):
    x = clustered(3000)
    ids = [f"v{i:05d}" for i in range(len(x))]
    rows = [(i, [float(v) for v in r], k % 10 == 0, "x", 1) for k, (i, r) in enumerate(zip(ids, x, strict=True))]
    df = usable_vectors(spark.createDataFrame(rows, SCHEMA), "sql_id", "vector", F.col("is_probe"), 16)
    got = {}
    for r in nearest(df, 5, 16).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    want = brute(ids, x, range(0, len(x), 10), 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len({*got[q]} & {*want[q]}) for q in want) >= 0.95 * 5 * len(want)


def test_faulty_copied_and_few_vectors(spark):
    ok = [1.0, 0.0, 0.0]
    rows = [("a", ok, True), ("a", ok, False), ("b", [2.0, 0.0, 0.0], False), ("c", [0.0, 1.0, 0.0], False), ("z", [0.0, 0.0, 0.0], True), ("n", None, True), ("s", [1.0], True), ("h", [1.0, None, 0.0], True), ("i", [float("inf"), 0.0, 0.0], True), ("m", [float("nan"), 0.0, 0.0], True), (None, ok, True)]
    df = usable_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), "sql_id", "vector", F.col("is_probe"), 3)
    assert [(r.id, r.neighbour, round(r.cosine, 6)) for r in nearest(df, 5, 3).orderBy("rank").collect()] == [("a", "b", 1.0), ("a", "c", 0.0)]
    assert nearest(df.limit(0), 5, 3).count() == 0


def test_copies_are_one_item(spark, monkeypatch):
    monkeypatch.setattr("gridloom.llm.neighbours.GROUP_ROWS", 50)
    rows = [(f"c{i:04d}", [1.0, 1.0], i == 7, "x", 1) for i in range(400)] + [("far", [-1.0, 1.0], True, "x", 1)]
    df = usable_vectors(spark.createDataFrame(rows, SCHEMA), "sql_id", "vector", F.col("is_probe"), 2)
    got = [r.neighbour for r in nearest(df, 3, 2).where("id = 'c0007'").orderBy("rank").collect()]
    assert got == ["c0000", "c0001", "c0002"]  # equal cosines go to the smaller ids


def test_enlarged_leaves_get_trees_of_their_own(spark, monkeypatch):
    """A sample of a hundredth of the rows: the leaves below stay small and near rows are found all the same."""
    from gridloom.llm import neighbours

    for name, value in (("FIT_ROWS", 60), ("MAX_LEAF", 150), ("SUB_ROWS", 400), ("GROUP_ROWS", 300)):
        monkeypatch.setattr(neighbours, name, value)
    x = clustered(6000, seed=3)
    ids = [f"v{i:05d}" for i in range(len(x))]
    rows = [(i, [float(v) for v in r], k % 20 == 0, "x", 1) for k, (i, r) in enumerate(zip(ids, x, strict=True))]
    df = usable_vectors(spark.createDataFrame(rows, SCHEMA), "sql_id", "vector", F.col("is_probe"), 16)
    got = {}
    for r in nearest(df, 5, 16).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = brute(ids, x, range(0, len(x), 20), 5)
    assert set(got) == set(want) and sum(len(got[q] & {*want[q]}) for q in want) >= 0.95 * 5 * len(want)


@pytest.mark.parametrize("rows", [100_000, 1_000_000, 10_000_000])
def test_leaves_stay_small_at_every_size(rows):
    """Rows of a leaf below a leaf, as the two samples cut them."""
    from gridloom.llm.neighbours import FIT_ROWS, MAX_LEAF, SUB_ROWS, leaf_rows

    sample = min(rows, int(0.9 * FIT_ROWS))
    first = rows * leaf_rows(sample, rows) / sample
    below = first if first <= MAX_LEAF else first * leaf_rows(min(first, SUB_ROWS), first, 8) / min(first, SUB_ROWS)
    assert below <= MAX_LEAF


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_every_row_has_a_leaf_in_every_tree(n):
    x = clustered(n) if n else np.zeros((0, 16), np.float32)
    f = Forest(x, 128, trees=3)
    leaves = f.leaves_of(x)
    assert leaves.shape == (n, 3) and all((leaves[:, t] >= f.first[t]).all() and (leaves[:, t] < f.first[t + 1]).all() for t in range(3))
    assert all(len(set(o)) == len(o) for o in f.search(x[:5], 4))
