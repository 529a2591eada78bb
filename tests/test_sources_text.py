import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.operators import extract, mentions
from gridloom.session import running_before
from gridloom.sources import documents, sinks


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]


def test_text_functions(spark):
    assert one(spark, text.normalize_name, "M/s Kite Alloys Pvt. Ltd.", "Mr. A-B Private Limited", "1,200,000 & co", None) == ["kite alloys pvt ltd", "ab pvt ltd", "1200000 and co", ""]
    assert one(spark, text.parse_numbers, "INR 1,26,00,000 or 12.6 million, v2 at 5%", None, "3 cr") == [[12600000.0, 12600000.0, 5.0], [], [3e7]]
    assert one(spark, text.yes_no, "Yes, it is", "It is not", "maybe", None) == ["yes", "no", None, None]
    assert one(spark, text.is_abstention, "Not found in it", "", "42") == [True, True, False]
    assert one(spark, lambda c: text.word_windows(c, 3, 1), "a b c d e", "a", "", None) == [["a b c", "c d e"], ["a"], [], []]
    assert one(spark, text.tokens, "R&D's co-op 3.5x!", None) == [["r&d's", "co-op", "3.5x"], []]
    assert one(spark, lambda c: text.char_slices(c, F.lit(3)), "abcdefgh") == [["ab", "cd", "efgh"]]
    assert one(spark, text.strip_fences, "x ```json\n{}\n``` y", " {} ") == ["{}", "{}"]
    assert one(spark, text.render_markup, "see [[E1|Acme]].") == ["see Acme."]
    assert one(spark, text.clean_lines, " a \t b \n\n c ") == ["a b\nc"]
    assert one(spark, lambda c: text.text_quality(c, F.lit(None).cast("double")), "", "plain words here") == [0.0, pytest.approx(0.4 * 0.5 + 0.3 * 14 / 16 + 0.2 + 0.1)]
    with pytest.raises(ValueError):
        text.word_windows(F.lit(""), 0, 0)


def office(parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return buf.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_parsers(spark, tmp_path):
    docx = office({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>"})
    xlsx = office({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Main" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><X Id="r1" Target="worksheets/s.xml"/></R>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>head</t></si></sst>", "xl/worksheets/s.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>'})
    for name, data in (("a.docx", docx), ("b.xlsx", xlsx), ("c.PNG", b"img"), ("d.pdf", b"layer"), ("e.pdf", b"scan"), ("f.docx", b"broken"), ("g.txt", b"ignored")):
        (tmp_path / name).write_bytes(data)
    read = lambda content: [([0], content.decode(), 0.8), ([1], "x", 0.6)]
    pdf = documents.PdfParser(lambda c: ["t" * 200, "second"] if c == b"layer" else ["", ""], lambda c: [read(c)])
    pages = documents.parse_files(documents.scan_directory(spark, str(tmp_path)), [documents.DocxParser(), documents.XlsxParser(), documents.ImageParser(read), pdf]).collect()
    by = {}
    for p in pages:
        by.setdefault(p.doc_name, []).append(p)
    assert by["a"][0].text == "One\nTwo" and by["a"][0].warning == "text only" and by["b"][0].text == "SHEET: Main\n\nhead\t5"
    assert by["c"][0].confidence == pytest.approx(0.7) and len(by["d"]) == 2 and by["e"][0].text == "scan\nx" and by["f"][0].error.startswith("BadZipFile") and "g" not in by
    assert [p["text"] for p in documents.DocxParser(lambda c: 2).parse("a.docx", docx)] == ["One", "\nTwo"]


def test_text_and_extraction_folders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain\ntext")
    (tmp_path / "b.json").write_text('{"pages": ["p1", "p2"]}')
    (tmp_path / "c.json").write_text('{"pages": [{"text": "", "content": "c1"}, {"text": "t2"}]}')
    (tmp_path / "d d_entities.json").write_text('{"entities": [{"id": "E1", "type": "Person", "attributes": {"name": "Ann", "type": "x", "page_number": "4"}}, {"id": "", "attributes": {}}], "relationships": [{"from_id": "E1", "to_id": "ENTITY_1", "attributes": {}}, {"from_id": "E1", "to_id": "zz"}]}')
    texts = {r.document: r.text for r in documents.read_texts(spark, str(tmp_path)).where("text <> ''").collect()}
    assert texts == {"a": "plain\ntext", "b": "p1\np2", "c": "c1\nt2"}
    x = documents.read_extractions(spark, str(tmp_path))
    nodes = mentions.mentions(x)
    got = {r.node_id: r for r in nodes.collect()}
    assert set(got) == {"node_1_E1", "node_2_ENTITY_1"} and got["node_1_E1"].attrs == {"name": "Ann", "attr_type": "x"} and got["node_1_E1"].page_numbers == [4]
    edges = mentions.mention_edges(x, nodes).collect()
    assert [(e.src, e.dst, e.relationship_type) for e in edges] == [("node_1_E1", "node_2_ENTITY_1", "RELATED_TO")]
    assert documents.latest(spark, str(tmp_path / "*.json")).endswith("d d_entities.json") and documents.latest(spark, str(tmp_path / "*.none")) is None


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("n<1>", {"name": 'A "&" B', "x": None})], "node_id string, attrs map<string,string>")
    edges = spark.createDataFrame([("n<1>", "n2", {"t": "line\nbreak"})], "src string, dst string, attrs map<string,string>")
    sinks.write_graphml(nodes, edges, str(tmp_path / "g"))
    n, e = documents.read_graphml(spark, str(tmp_path / "g" / "*"))
    assert [(r.node_id, r.attrs) for r in n.collect()] == [("n<1>", {"name": 'A "&" B'})] and [(r.src, r.dst, r.attrs) for r in e.collect()] == [("n<1>", "n2", {"t": "line\nbreak"})]
    path = str(tmp_path / "t")
    for k in (1, 2):
        sinks.replace_table(spark.range(k), path)
    sinks.append_table(spark.range(1), path)
    assert spark.read.parquet(path).count() == 3


def test_replies_are_asked_once(spark, tmp_path):
    log = tmp_path / "asked"

    def ask(pdf: pd.DataFrame):
        with open(log, "a") as f:
            f.write("".join(f"{q}\n" for q in pdf["q"]))
        return [q.upper() for q in pdf["q"]]

    df = spark.createDataFrame([("a",), ("a",), ("b",)], "q string")
    for _ in range(2):
        assert sorted(r.reply for r in sinks.cached_replies(df, ["q"], str(tmp_path / "cache"), ask).collect()) == ["A", "A", "B"]
    assert sorted(log.read_text().split()) == ["a", "b"]


def test_packing_and_replies(spark):
    pages = spark.createDataFrame([("d", i, n) for i, n in enumerate([50, 60, 300, 10, 20], 1)] + [("e", 1, 1)], "doc_name string, page_number int, n_tokens long")
    got = {(r.doc_name, r.page_number): r.chunk for r in extract.pack_pages(pages, 130, 10).collect()}
    assert got == {("d", 1): 1, ("d", 2): 1, ("d", 3): 2, ("d", 4): 3, ("d", 5): 3, ("e", 1): 1}
    assert extract.repair_json("say ```json\n[1, 2") == [1, 2] and extract.repair_json('{"a": 1,}') == {"a": 1} and extract.repair_json("no") is None

    def ask(t):
        if t == "fail":
            raise RuntimeError("down")
        return '```json\n{"entities": [{"id": "A", "attributes": {"name": "x"}}]' if t == "good" else "{}"

    out = extract.extract(spark.createDataFrame([("d", 1, "good"), ("d", 2, "fail"), ("d", 3, "y" * 300)], "doc_name string, chunk int, text string"), ask)
    assert {r.chunk: (len(r.entities), r.error) for r in out.collect()} == {1: (1, None), 2: (0, "RuntimeError: down"), 3: (0, None)}


def test_merge_of_mentions(spark):
    nodes = spark.createDataFrame([("n1", 1, "P", "o1", "d1", [2], {"name": "A"}), ("n2", 2, "P", "o2", "d2", [1], {"name": "B", "x": "1"}), ("n3", 3, "P", "o3", "d1", [], {"name": "C"})], "node_id string, ord int, type string, original_id string, source_doc string, page_numbers array<int>, attrs map<string,string>")
    edges = spark.createDataFrame([("n1", "n3", 1, "K", "d1", {}), ("n2", "n3", 2, "L", "d2", {}), ("n1", "n2", 3, "M", "d1", {})], "src string, dst string, ord int, relationship_type string, source_doc string, attrs map<string,string>")
    clusters = spark.createDataFrame([("n1", "c"), ("n2", "c")], "node_id string, cluster_id string")
    reps = mentions.representatives(nodes, clusters)
    m = {r.node_id: r for r in mentions.merge_nodes(nodes, reps).collect()}
    assert set(m) == {"n2", "n3"} and m["n2"].attrs == {"name": "A"} and m["n2"].page_numbers == [1, 2] and m["n2"].cluster_size == 2
    assert [(e.src, e.dst, e.relationship_type, e.source_docs) for e in mentions.merge_edges(edges, reps).collect()] == [("n2", "n3", "K", ["d1", "d2"])]
    assert mentions.merge_edges(edges, reps, multi_edge=True).count() == 2
    groups = spark.createDataFrame([("g1", "n1", "same"), ("g1", "n2", "same"), ("g2", "n1", "part")], "group_id string, node_id string, reasoning string")
    assert [tuple(r) for r in mentions.merge_reasons(clusters, groups).collect()] == [("c", "same")]
    assert tuple(mentions.reduction(nodes, clusters).first()) == (1, 3, 2, pytest.approx(33.3333))


def test_running_sums_over_partitions(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "o int, v int").repartition(7)
    got = {r.o: r.s for r in running_before(df, ["o"], "v", "s").collect()}
    assert got == {i: sum(j % 3 for j in range(i)) for i in range(100)}


def test_gold_standard(spark, tmp_path):
    files = {
        "entities": '[{"id": "E1", "type": "Person", "canonical_name": "Ann", "aliases": ["A."], "ambiguous_surfaces": []}]',
        "relations": '[{"from": "E1", "type": "OWNS", "to": "E2", "attributes": {"pct": 4}, "documents": ["d"]}]',
        "occurrences": '[{"document": "d", "page": 2, "entity_id": "E1", "surface": "Ann"}]', "documents": "[]",
        "questions": '[{"id": "q", "type": "lookup", "answer_type": "entity_list", "answer": ["E1", "E2"], "evidence_paths": [[["E1", "E2"]]], "priority": 3}, {"id": "r", "answer": 5}]',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    gold = documents.read_gold(spark, str(tmp_path))
    assert {n: df.count() for n, df in gold.items()} == {"entities": 1, "relations": 1, "occurrences": 1, "documents": 0, "questions": 2}
    assert {r.id: r.answer for r in gold["questions"].collect()} == {"q": '["E1", "E2"]', "r": "5"}
    assert gold["relations"].first().attributes == {"pct": "4"} and gold["questions"].where("id = 'q'").first().evidence_paths == [[["E1", "E2"]]]
