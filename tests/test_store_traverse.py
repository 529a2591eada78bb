from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.operators.store import build_store, convert_graph, insert_or_ignore, load_graph, open_store, relationship_details, upsert_last
from gridloom.plans.orchestrate import FLASHLIGHT, LASER, Orchestrator, Plan
from gridloom.plans.traverse import SecureTraversal, allowed_documents

T0 = datetime(2024, 1, 1)
IDS = {n: f"{i:016x}" for i, n in enumerate(["ann", "ben", "cox", "dee", "eve"])}


@pytest.fixture(scope="module")
def store(spark):
    docs = [("d1", "One", "f", '["UNCLASSIFIED"]', T0, None), ("d2", "Two", "f", '["AUDIT"]', T0, None), ("d3", "Three", "f", '["unclassified"]', T0, None), ("d4", "Four", "f", "AUDIT", T0, None), ("d1", "One", "f", '["UNCLASSIFIED"]', T0, None), ("d5", "Gone", "f", '["UNCLASSIFIED"]', T0, T0), (None, "x", "f", None, T0, None)]
    ents = [(i, IDS[n], "person", n.title(), 1, "{}", None, None, None) for i, n in enumerate(IDS)] + [(9, IDS["ann"], "Person", "Ann Last", 4, "{}", None, None, None)]
    rels = [("r1", "KNOWS", "ann", "ben", "OPEN"), ("r2", "OWNS", "cox", "ben", "OPEN"), ("r3", "KNOWS", "cox", "dee", "OPEN"), ("r4", "HIDES", "ann", "dee", "RESTRICTED"), ("r5", "KNOWS", "dee", "eve", "OPEN"), ("r6", "LEADS", "eve", "nobody", "OPEN"), ("r0", "KNOWS", "ben", "ann", "OPEN")]
    occ = [(1, "ann", "d1", "[2, 1]"), (2, "ann", "d1", "[1, 3]"), (3, "ben", "d1", "[1]"), (4, "cox", "d2", "[7]"), (5, "dee", "d3", None), (6, "dee", "d2", "[]"), (7, "eve", "d4", "[1]"), (8, "ben", "d3", '["4"]')]
    ds = spark.createDataFrame(docs, "document_id string, document_name string, file_path string, access_tags string, created_at timestamp, deleted_at timestamp")
    es = spark.createDataFrame(ents, "load_seq long, unique_entity_id string, entity_type string, canonical_name string, cluster_size int, attributes string, name_variants string, merge_reasoning string, deleted_at timestamp")
    rs = spark.createDataFrame([(i, r, t, IDS.get(a, a), f" {IDS.get(b, b).upper()}", "{}", p) for i, (r, t, a, b, p) in enumerate(rels)], "load_seq long, relationship_id string, relationship_type string, from_entity_id string, to_entity_id string, attributes string, access_policy string")
    os_ = spark.createDataFrame([(i, IDS[e], d, p) for i, e, d, p in occ], "load_seq long, entity_id string, document_id string, page_numbers string")
    return build_store(ds, es, rs, os_)


def ids(df, col="entity_id"):
    back = {v: k for k, v in IDS.items()}
    return {back[r[col]] for r in df.collect()}


def test_store_keeps_the_last_row_and_live_ends(store):
    assert {r.canonical_name for r in store.entities.collect()} == {"Ann Last", "Ben", "Cox", "Dee", "Eve"}
    assert {r.relationship_id for r in store.relationships.collect()} == {"r0", "r1", "r2", "r3", "r4", "r5"}
    assert {r.document_name for r in store.documents.collect()} == {"One", "Two", "Three", "Four"}
    assert {r.table_name: r.n_rows for r in store.counts().collect()}["occurrences"] == 7


def test_rights(spark, store):
    names = lambda tags: {r.document_name for r in allowed_documents(store.documents, tags).collect()}
    assert names([]) == {"One", "Three"} and names(["AUDIT"]) == {"One", "Two", "Three"} and names(["audit"]) == {"One", "Three"}


def test_walk_needs_rights_and_open_edges(spark, store):
    mine, all_ = SecureTraversal(store, []), SecureTraversal(store, ["AUDIT"])
    start = spark.createDataFrame([(IDS["ann"],)], "entity_id string")
    assert ids(mine.grounded) == {"ann", "ben", "dee"}
    assert ids(mine.reached(start, 3)) == {"ann", "ben"}
    assert {(r.entity_id, r.depth) for r in all_.reached(start, 3).collect()} == {(IDS["ann"], 0), (IDS["ben"], 1), (IDS["cox"], 2), (IDS["dee"], 3)}
    with pytest.raises(ValueError):
        mine.reached(start, -1)
    assert ids(mine.reached(spark.createDataFrame([(IDS["eve"],)], "entity_id string"), 2)) == set()


def test_context_and_citations(store):
    c = SecureTraversal(store, []).context([IDS["ann"]], 1).to_dict()
    assert {n["canonical_name"] for n in c["nodes"]} == {"Ann Last", "Ben"} and {e["relationship_id"] for e in c["mini_graph"]} == {"r0", "r1"}
    assert c["citation_context"] == {"One": [1, 3], "Three": [4]}
    assert SecureTraversal(store, []).context([], 2).to_dict() == {"nodes": [], "mini_graph": [], "citation_context": {}}
    d = SecureTraversal(store, ["AUDIT"])
    assert {r.document_name: r.pages for r in d.citations(d.grounded).collect()} == {"One": [1, 3], "Two": [7], "Three": [4]}


def test_paths(store):
    walk = SecureTraversal(store, ["AUDIT"])
    assert walk.shortest_path(IDS["ann"], IDS["dee"]) == [IDS[n] for n in ("ann", "ben", "cox", "dee")]
    assert [r.relationship_id for r in walk.path_edges([IDS["ann"], IDS["ben"], IDS["cox"]]).orderBy("step").collect()] == ["r1", "r2"]
    assert walk.shortest_path(IDS["ann"], IDS["ann"]) == [IDS["ann"]] and walk.shortest_path(IDS["ann"], IDS["eve"]) is None
    assert SecureTraversal(store, []).shortest_path(IDS["ann"], IDS["dee"]) is None
    assert walk.path_edges([]).count() == 0


def test_upserts(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "y"), (None, 5, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in upsert_last(df, ["k"], ["o"]).collect()} == {("a", "x"), ("b", "y")}
    assert {(r.k, r.v) for r in insert_or_ignore(df, ["k"], ["o"]).collect()} == {("a", None), ("b", "y")}
    assert [r.k for r in insert_or_ignore(df, ["k"], ["o"], df.where("k = 'a'")).collect()] == ["b"]


def test_missing_tables_are_named(spark, tmp_path):
    with pytest.raises(ValueError, match="entities"):
        open_store(spark, str(tmp_path))


def test_conversion(spark):
    node = "node_id string, ord int, type string, original_id string, source_doc string, source_docs array<string>, page_numbers array<int>, cluster_size int, attrs map<string,string>"
    nodes = spark.createDataFrame([("n1", 1, "Company", "C1", "a", ["a", "b"], [1, 2], 3, {"name": "Acme", "x": "1", "type": "t"}), ("n2", 2, "company", "C2", "b", None, [5], 1, {"name": " ACME ", "x": None}), ("n3", 3, None, "P1", "b", None, [], None, {"name": ""})], node)
    edge = "src string, dst string, ord int, relationship_type string, source_doc string, source_docs array<string>, attrs map<string,string>"
    edges = spark.createDataFrame([("n1", "n3", 1, None, "a", None, {"k": "v"}), ("n2", "n3", 2, None, "b", None, {"k": "w"}), ("n1", "zz", 3, "X", "a", None, {})], edge)
    t = convert_graph(nodes, edges)
    assert {(r.canonical_name, r.cluster_size) for r in t["entities"].collect()} == {(" ACME ", 1), ("P1", 1)}
    assert t["documents"].count() == 2 and t["entity_occurrences"].count() == 3
    assert [(r.relationship_type, r.attributes, r.access_policy) for r in t["relationships"].collect()] == [("RELATED_TO", '{"k":"w"}', "OPEN")]


def test_merged_nodes_keep_their_history_and_load_twice_alike(spark, tmp_path):
    node = "node_id string, ord int, type string, original_id string, source_doc string, source_docs array<string>, page_numbers array<int>, cluster_size int, attrs map<string,string>"
    why = '{"merged_entities": ["n1", "n9"], "confidence": 0.9}'
    nodes = spark.createDataFrame([("n1", 1, "Company", "C1", "a", ["a"], [1], 2, {"name": "Acme", "merge_reasoning": why}), ("n2", 2, "Person", "P1", "b", None, [5], 1, {"name": "Ann", "merge_reasoning": '{"x": 1}'})], node)
    edges = spark.createDataFrame([("n1", "n2", 1, "OWNS", "a", None, {"k": "v", "pages": "[3]"})], "src string, dst string, ord int, relationship_type string, source_doc string, source_docs array<string>, attrs map<string,string>")
    got = {r.canonical_name: (r.name_variants, r.merge_reasoning, r.attributes) for r in convert_graph(nodes, edges)["entities"].collect()}
    assert got == {"Acme": (["n1"], why, "{}"), "Ann": (None, '{"x": 1}', "{}")}
    rows = lambda t: {n: sorted(map(str, df.collect())) for n, df in t.items()}
    first = rows(load_graph(nodes, edges, str(tmp_path)))
    assert rows(load_graph(nodes, edges, str(tmp_path))) == first and [len(v) for v in first.values()] == [2, 2, 1, 2, 1]
    more = load_graph(nodes.where("node_id = 'n1'").withColumn("cluster_size", F.lit(7)), edges.limit(0), str(tmp_path))
    assert {(r.canonical_name, r.cluster_size) for r in more["entities"].collect()} == {("Acme", 7), ("Ann", 1)}


def test_relationships_are_cited_and_long_paths_found(spark, store):
    from dataclasses import replace

    seen = spark.createDataFrame([("r1", "d3", [9]), ("r2", "d1", [8])], "relationship_id string, document_id string, page_numbers array<int>")
    cited = replace(store, relationship_occurrences=seen)
    c = SecureTraversal(cited, []).context([IDS["ann"]], 1).to_dict()
    assert c["citation_context"] == {"One": [1, 3], "Three": [4, 9]}
    assert {r.relationship_id: r.documents for r in relationship_details(cited).collect()}["r1"] == "Three"
    n = 70
    key = lambda i: f"{i:016x}"
    long_ = replace(
        store, entities=spark.createDataFrame([(key(i), "Person", f"P{i}", 1, "{}") for i in range(n)], "unique_entity_id string, entity_type string, canonical_name string, cluster_size int, attributes string"),
        relationships=spark.createDataFrame([(f"e{i}", "NEXT", key(i), key(i + 1), "{}", "OPEN") for i in range(n - 1)], "relationship_id string, relationship_type string, from_entity_id string, to_entity_id string, attributes string, access_policy string"),
        occurrences=spark.createDataFrame([(key(i), "d1", [1]) for i in range(n)], "entity_id string, document_id string, page_numbers array<int>"),
    )
    assert SecureTraversal(long_, []).shortest_path(key(0), key(n - 1)) == [key(i) for i in range(n)]


def ask(store, plan, tags=(), texts=None, vectors=None):
    return Orchestrator(store, lambda q, seen, kinds: plan, lambda t: [1.0, 0.0], vectors, texts).ask("profit of Ben", list(tags))


def test_orchestrated_answers(spark, store):
    texts = spark.createDataFrame([("One", 0, "the profit of ben rose"), ("Two", 0, "profit profit secret")], "document string, chunk int, text string")
    vectors = spark.createDataFrame([(IDS["ann"], [1.0, 0.0]), (IDS["cox"], [0.9, 0.1])], "sql_id string, vector array<double>")
    a = ask(store, Plan(FLASHLIGHT, names=["Ann"]), vectors=vectors)
    assert a.status == "success" and {n["canonical_name"] for n in a.nodes} == {"Ann Last", "Ben"}
    assert ask(store, Plan(FLASHLIGHT, types=["Person"])).status == "success"
    assert ask(store, Plan(FLASHLIGHT, relationship_types=["HIDES"])).status == "success"
    assert ask(store, Plan(LASER, IDS["ann"], IDS["dee"]), ["AUDIT"]).nodes[0]
    no = ask(store, Plan(LASER, IDS["ann"], IDS["cox"]), texts=texts)
    assert no.status == "no_access" and not no.passages and "Cox" not in no.message
    lost = ask(store, Plan("elsewhere"), texts=texts)
    assert lost.status == "text_fallback" and [p["document"] for p in lost.passages] == ["One"]
    assert ask(store, Plan("elsewhere")).status == "ambiguous"
    assert ask(store, None).status == "error"
