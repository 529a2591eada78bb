import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions.similarity import indel_ratio, jaro_winkler, jaro_winkler_levels, lcs_length
from gridloom.operators import communities, graph, resolve
from gridloom.operators.components import connected_components
from gridloom.operators.evaluate import align, alias_index, recognise, smallest_cover


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {(x, find(x)) for x in parent}


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs_against_the_table(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    assert lcs_length(a, b) == t[-1, -1]


def test_ratios():
    assert indel_ratio("", "") == 100 and indel_ratio(None, "a") == 0 and indel_ratio("abcd", "abxd") == pytest.approx(75)
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and jaro_winkler("", "a") == 0 and jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)


@pytest.mark.parametrize("threshold", [70.0, 90.0])
def test_near_texts_lose_no_pair(spark, threshold):
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randrange(3, 22))).strip() for _ in range(60)]
    texts = set(base)
    for b in base * 3:
        w = list(b)
        for _ in range(rnd.randrange(1, 4)):
            if w:
                i = rnd.randrange(len(w))
                w[i : i + rnd.randrange(2)] = rnd.choice(["", "a", "x"])
        texts.add("".join(w))
    texts = sorted(texts - {""})
    df = spark.createDataFrame([(t, "g") for t in texts], "text string, g string")
    got = {(r.left, r.right) for r in resolve.near_texts(df, threshold, ["g"]).collect()}
    want = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if indel_ratio(a, b) >= threshold}
    assert got == want and want


MENTION = "node_id string, type string, name string, role string, din string, ord int"
PEOPLE = [("a1", "P", "Acme Pvt Ltd", None, None), ("a2", "P", "ACME Private Limited", None, None), ("a3", "C", "Acme Pvt Ltd", None, None), ("b1", "P", "Meera Kulkarni", "director", "1"), ("b2", "P", "Meera Kulkarny", "Director", "1"), ("b3", "P", "Meera Kulkarni", "clerk", "2"), ("c", "P", None, None, None), ("d", None, "", None, None), ("e", None, "Solo", None, None), ("f", None, "solo", None, None)]


@pytest.fixture(scope="module")
def mentions(spark):
    return spark.createDataFrame([(*m, i) for i, m in enumerate(PEOPLE)], MENTION)


def sets(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.cluster_id].add(r.node_id)
    assert all(len(v) > 1 for v in out.values())
    return sorted(map(sorted, out.values()))


def test_string_methods(spark, mentions):
    assert sets(resolve.exact_clusters(mentions)) == [["a1", "a2", "a3"], ["b1", "b3"], ["e", "f"]]
    assert sets(resolve.fuzzy_clusters(mentions)) == [["a1", "a2"], ["b1", "b2", "b3"], ["e", "f"]]
    assert sets(resolve.closure_clusters(mentions, text=("role",), exact=("din",))) == [["b1", "b2"], ["e", "f"]]
    assert sets(resolve.fuzzy_clusters(mentions.limit(0))) == []
    assert set(resolve.resolvers()) == {"exact", "fuzzy", "closure", "topological", "semantic", "probabilistic"}
    assert sets(resolve.resolvers()["fuzzy"].resolve(mentions)) == sets(resolve.fuzzy_clusters(mentions))


def test_closure_scores_against_the_definition(spark, mentions):
    rows = [p for p in PEOPLE if p[2]]

    def score(x, y):
        terms = [(indel_ratio(x[2].lower(), y[2].lower()) / 100, 2)]
        if x[3] and y[3]:
            terms.append((indel_ratio(x[3].lower(), y[3].lower()) / 100, 1))
        if x[4] and y[4]:
            terms.append((float(x[4] == y[4]), 1))
        return sum(s * w for s, w in terms) / sum(w for _, w in terms)

    want = {(x[0], y[0]): score(x, y) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and (x[2].lower(), x[3], x[4]) != (y[2].lower(), y[3], y[4]) and score(x, y) >= 0.6}
    got = {(r.a, r.b): r.score for r in resolve.closure_links(mentions, 0.6, ("role",), ("din",)).collect()}
    assert got == pytest.approx(want)


def test_neighbourhoods_against_all_pairs(spark):
    rnd = random.Random(8)
    nodes = [(f"n{i:02d}", "T" if i % 2 else "U", f"name {rnd.choice('abc')} {i % 3}") for i in range(40)] + [("i1", "T", "lone wolf"), ("i2", "T", "Lone Wolf"), ("i3", "T", "")]
    edges = [(f"n{rnd.randrange(40):02d}", f"h{rnd.randrange(4)}") for _ in range(90)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    pairs = []
    for i, (a, t, n) in enumerate(nodes):
        for b, u, m in nodes[i + 1 :]:
            if t == u:
                words = jac(set(n.lower().split()), set(m.lower().split()))
                s = words if not near[a] and not near[b] else 0.7 * jac(near[a], near[b]) + 0.3 * words
                if s >= 0.7 - 1e-9:
                    pairs.append((a, b))
    n = spark.createDataFrame(nodes, "node_id string, type string, name string")
    e = spark.createDataFrame(edges, "src string, dst string")
    assert {(r.node_id, r.cluster_id) for r in resolve.topological_clusters(n, e).collect()} == components(pairs)


def test_vectors_and_linkage(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("c", [0.0, 1.0]), ("d", None)]
    df = spark.createDataFrame(rows, "node_id string, vector array<double>")
    assert sets(resolve.semantic_clusters(df, 0.9)) == [["a", "b"]]
    assert {(r.a, r.b) for r in resolve.semantic_pairs(df, 0.9, blocks=3).collect()} == {("a", "b"), ("b", "a")}
    assert resolve.semantic_pairs(df.limit(0), 0.9).count() == 0
    assert len(set(resolve.average_linkage(np.array([[1.0, 0], [1, 0.1], [0, 1]]), 0.9))) == 2


def test_estimation_raises_the_likelihood():
    rng = np.random.default_rng(1)
    match = rng.random(4000) < 0.1
    levels = np.stack([np.where(match, rng.random(4000) < 0.9, rng.random(4000) < 0.1).astype(int) for _ in range(4)], axis=1)
    levels[rng.random(4000) < 0.05, 2] = -1
    patterns, counts = np.unique(levels, axis=0, return_counts=True)
    model = resolve.estimate(patterns, counts.astype(float), prior=0.01, rounds=60)
    assert all(b >= a - 1e-6 for a, b in zip(model["log_likelihood"], model["log_likelihood"][1:], strict=False))
    assert model["prior"] == pytest.approx(0.1, abs=0.02)
    assert resolve.match_probability(np.array([[1, 1, 1, 1], [0, 0, 0, 0]]), model).round(2).tolist() == [1.0, 0.0]


def test_model_resolver_batches_and_reconciles(spark):
    ms = spark.createDataFrame([(f"m{i:03d}", "P", f"name{i % 7}", i) for i in range(70)], "node_id string, type string, name string, ord int")

    def asks(pdf):
        return [list(g["node_id"]) for _, g in pdf.groupby("name")]

    assert len(sets(resolve.model_resolve(ms, asks))) == 7
    assert resolve.model_batches(ms).groupBy("batch").count().agg({"count": "max"}).first()[0] == 30
    assert sets(resolve.model_resolve(ms, lambda pdf: [["zz", "m001"], ["m001"]])) == []


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    pairs = [(f"{rnd.randrange(80):02d}", f"{rnd.randrange(80):02d}") for _ in range(50)] + [(f"x{i:02d}", f"x{i + 1:02d}") for i in range(30)]
    df = spark.createDataFrame([*pairs, (None, "a"), ("b", None), ("c", "c")], "src string, dst string")
    assert {(r.node, r.component) for r in connected_components(df).collect()} == components([p for p in pairs if p[0] != p[1]])
    assert connected_components(df.limit(0)).count() == 0


def test_graph_metrics(spark):
    n = spark.createDataFrame([(x,) for x in "abcde"], "node_id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b"), ("d", "d")], "src string, dst string")
    m = graph.metrics(n, e).first()
    assert (m.n_nodes, m.n_edges, m.components, m.avg_degree) == (5, 6, 2, 1.2) and m.density == 0.3
    assert m.avg_clustering == pytest.approx((1 + 1 + 1 / 3) / 5, abs=1e-6)
    empty = graph.metrics(n, e.limit(0)).first()
    assert empty.entity_relationship_ratio == float("inf") and empty.components == 5 and empty.avg_clustering == 0
    got = {r.node_id: r["rank"] for r in graph.page_rank(n, e).collect()}
    ids, m = list("abcde"), np.zeros((5, 5))
    for a, b in {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")}:
        m[ids.index(b), ids.index(a)] = 1
    m = np.where(m.sum(0) > 0, m / np.maximum(m.sum(0), 1), 1 / 5)
    want = np.linalg.solve(np.eye(5) - 0.85 * m, np.full(5, 0.15 / 5))
    assert [got[i] for i in ids] == pytest.approx(want, abs=1e-7)
    assert [graph.batch_size(t) for t in (0, 5, 95, 10_000)] == [1, 1, 10, 25]


def test_leiden_finds_planted_groups_and_keeps_invariants(spark):
    rnd = random.Random(9)
    edges = [(f"{g}{i}", f"{g}{j}") for g in "abcd" for i in range(8) for j in range(i) if rnd.random() < 0.7] + [("a0", "b0"), ("b1", "c1"), ("c2", "d2")]
    nodes = spark.createDataFrame([(f"{g}{i}",) for g in "abcd" for i in range(8)] + [("alone",)], "node_id string")
    df = spark.createDataFrame(edges, "src string, dst string")
    found = {r.node_id: r.community for r in communities.detect(nodes, df).collect()}
    assert len(found) == 33 and found["alone"] == "alone" and len(set(found.values())) == 5
    assert all(found[f"{g}{i}"] == found[f"{g}0"] for g in "abcd" for i in range(8))
    assert found == {r.node_id: r.community for r in communities.detect(nodes, df).collect()}
    inside = [(a, b) for a, b in edges if found[a] == found[b]]
    assert {x for x, _ in components(inside)} == {n for n in found if n != "alone"}
    q = graph.modularity(df, communities.detect(nodes, df)).first()[0]
    assert q > 0.6
    coarse = communities.detect(nodes, df, max_edges=40)
    assert coarse.count() == 33 and graph.modularity(df, coarse).first()[0] > 0.3
    fine, wide = (communities.detect(nodes, df, g).select("community").distinct().count() for g in (2.0, 0.05))
    assert fine >= 5 >= wide


def test_recognition(spark):
    alias = spark.createDataFrame([("acme", "A"), ("acme steel", "B"), ("orion", "C"), ("orion", "D"), ("Mr. Vega", "E")], "alias string, entity string")
    index = alias_index(alias, spark.createDataFrame([("vega corp",)], "alias string"))
    texts = spark.createDataFrame([(1, "Acme Steel and ACME met Vega; acme steel"), (2, "Orion"), (3, None), (4, "vega")], "id int, text string")
    assert {r.id: r.entities for r in recognise(texts, index).collect()} == {1: ["B", "A", "E"], 2: [], 3: [], 4: ["E"]}
    assert {r.id: r.entity for r in align(texts, index).collect()} == {1: None, 2: None, 3: None, 4: "E"}
    eleven = " ".join(f"w{i}" for i in range(11))
    long_ = alias_index(spark.createDataFrame([(eleven, "L")], "alias string, entity string"))
    assert [r.entities for r in recognise(spark.createDataFrame([(1, f"so {eleven} said")], "id int, text string"), long_).collect()] == [["L"]]
    many = spark.createDataFrame([(i, f"d{j:02d}") for i in range(30) for j in (i, (i + 1) % 30)], "id int, document string")
    assert len(smallest_cover(many.where("id < 20"))) == 10
    need = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, "z")], "id int, document string")
    assert smallest_cover(need, ["x", "y", "z"]) == ["y", "z"] and smallest_cover(need, ["x"]) is None


def test_jaro_winkler_of_whole_blocks():
    rng = random.Random(3)
    texts = ["", "a", "martha", "marhta", "x" * 70, *("".join(rng.choices("abcde ", k=rng.randint(1, 24))) for _ in range(150)), *("".join(rng.choices("ab", k=rng.randint(55, 80))) for _ in range(20))]
    for cuts in ([0.7, 0.9], [0.6], [0.9]):
        got = jaro_winkler_levels(texts, texts, cuts)
        wrong = [(a, b) for i, a in enumerate(texts) for j, b in enumerate(texts) if a and b and got[i, j] != sum(jaro_winkler(a, b) >= c for c in cuts)]
        assert not wrong


def test_linkage_compares_every_pair_of_a_type(spark):
    """Against all pairs of equal type one by one; names that differ in their first letters are linked too."""
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdefghiklmnoprstuv", k=9)) for _ in range(40)]
    data = [(f"n{k:03}", "p" if k % 3 else "q", stem if v < 2 else "z" + stem[1:], ("director", "", "auditor")[k % 2], str(k // 4) if v != 1 else None) for k, (stem, v) in enumerate((s, v) for s in stems for v in range(4))]
    df = spark.createDataFrame([*data, ("x1", None, stems[0], "director", "0"), ("x2", "p", None, None, None)], "node_id string, type string, name string, role string, din string")
    fuzzy, exact = {"name": (0.7, 0.9), "role": (0.7, 0.9)}, ("din",)
    as_set = lambda p: {(r.l_id, r.r_id, round(r.match_probability, 6)) for r in p.collect()}
    kinds, din = [F.col("type")], [F.col("din")]
    whole = as_set(resolve.linked_by_type(df, fuzzy, exact, F.col("type"), 0.8, rows=50))
    assert whole == as_set(resolve.probabilistic_pairs(df, fuzzy, exact, [kinds], 0.8))
    names = {r[0]: r[2] for r in data}
    assert any(names[a][0] != names[b][0] for a, b, _ in whole)
    both = as_set(resolve.linked_by_type(df, fuzzy, exact, F.col("type"), 0.8, rules=(din,), rows=50))
    assert both == as_set(resolve.probabilistic_pairs(df, fuzzy, exact, [kinds, din], 0.8))


def test_fs_matches_scores_every_pair_of_a_type(spark, sf, monkeypatch):
    """With the threshold at 0, as no pair of these tables reaches the query's own."""
    from gridloom.queries import resolve_queries as q

    whole = resolve.linked_by_type
    monkeypatch.setattr(resolve, "linked_by_type", lambda r, fuzzy, exact, kind, _, **kw: whole(r, fuzzy, exact, kind, 0.0, **kw))
    r, (_, din), fuzzy, exact = q._blocked(spark, sf)
    assert set(fuzzy) == {"name", "role", "address"} and exact == ("din",)
    expected = resolve.probabilistic_pairs(r, fuzzy, exact, [[F.col("type")], din], 0.0).select("l_id", "r_id", F.round("match_probability", 4))
    assert {tuple(x) for x in q.fs_matches(spark, sf).collect()} == {tuple(x) for x in expected.collect()} != set()
