"""Files to page rows.

A parser is an object with `supports(path)` and `parse(path, content)`, which yields pages as dicts of page_number, text,
metadata, confidence and warning. Office formats are read here from their XML; PDF pages and images need an injected text or
recognition engine. Every file is parsed in a task of its own; a failing file gives one row with its error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("pdf", "jpg", "jpeg", "png", "tiff", "docx", "xlsx")
PAGES = "path string, doc_name string, page_number int, text string, metadata map<string,string>, confidence double, warning string, error string"


def scan_directory(spark: SparkSession, path: str, extensions: Iterable[str] = EXTENSIONS) -> DataFrame:
    """(path, modificationTime, length, content) of the files with one of the extensions, in any case."""
    glob = "*.{" + ",".join(e for x in extensions for e in (x, x.upper())) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


class DocxParser:
    """Text of the non-blank paragraphs; slices of equal length when pages are known, else one page with a warning."""

    _W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def __init__(self, count_pages: Callable[[bytes], int] | None = None):
        self.count_pages = count_pages

    def supports(self, path: str) -> bool:
        return path.lower().endswith(".docx")

    def parse(self, path: str, content: bytes) -> Iterator[dict]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        paragraphs = ("".join(t.text or "" for t in p.iter(f"{self._W}t")) for p in root.iter(f"{self._W}p"))
        text = "\n".join(p for p in paragraphs if p.strip())
        n = self.count_pages(content) if self.count_pages else 0
        if n < 1:
            yield {"page_number": 1, "text": text, "warning": "text only"}
            return
        k = max(len(text) // n, 1)
        for i in range(n):
            yield {"page_number": i + 1, "text": text[i * k : (i + 1) * k] if i < n - 1 else text[i * k :]}


class XlsxParser:
    """One page per sheet: its name, then its rows with cells parted by tabs."""

    _S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    _R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

    def supports(self, path: str) -> bool:
        return path.lower().endswith((".xlsx", ".xlsm"))

    def parse(self, path: str, content: bytes) -> Iterator[dict]:
        s = self._S
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{s}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{s}si")]
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            for number, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{s}sheet"), 1):
                target = targets[sheet.get(self._R)].lstrip("/")
                root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
                rows = [[self._cell(c, shared) for c in row.iter(f"{s}c")] for row in root.iter(f"{s}row")]
                body = "\n".join("\t".join(r) for r in rows)
                meta = {"sheet_name": sheet.get("name") or "", "rows": str(len(rows)), "columns": str(max(map(len, rows), default=0))}
                yield {"page_number": number, "text": f"SHEET: {meta['sheet_name']}\n\n{body}", "metadata": meta}

    def _cell(self, cell, shared: list[str]) -> str:
        value = cell.find(f"{self._S}v")
        if cell.get("t") == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{self._S}t"))
        if value is None or value.text is None:
            return ""
        return shared[int(value.text)] if cell.get("t") == "s" else value.text


class ImageParser:
    """One page per image, read by recognise(content) -> [(box, text, confidence)]."""

    def __init__(self, recognise: Callable[[bytes], list[tuple[list, str, float]]]):
        self.recognise = recognise

    def supports(self, path: str) -> bool:
        return path.lower().endswith((".png", ".jpg", ".jpeg", ".tif", ".tiff"))

    def parse(self, path: str, content: bytes) -> Iterator[dict]:
        blocks = self.recognise(content)
        mean = sum(c for _, _, c in blocks) / len(blocks) if blocks else 0.0
        yield {"page_number": 1, "text": "\n".join(t for _, t, _ in blocks), "confidence": mean}


class PdfParser:
    """Pages from an engine: text_of(content) -> page texts; the whole file is recognised when its first three pages have no text.

    A text layer counts from more than 100 characters on any of the first three pages.
    """

    def __init__(self, text_of: Callable[[bytes], list[str]], recognise_pages: Callable[[bytes], list[list[tuple[list, str, float]]]]):
        self.text_of, self.recognise_pages = text_of, recognise_pages

    def supports(self, path: str) -> bool:
        return path.lower().endswith(".pdf")

    def parse(self, path: str, content: bytes) -> Iterator[dict]:
        texts = self.text_of(content)
        if any(len(t.strip()) > 100 for t in texts[:3]):
            for i, t in enumerate(texts, 1):
                yield {"page_number": i, "text": t, "metadata": {"has_text_layer": "true"}}
            return
        for i, blocks in enumerate(self.recognise_pages(content), 1):
            mean = sum(c for _, _, c in blocks) / len(blocks) if blocks else 0.0
            yield {"page_number": i, "text": "\n".join(t for _, t, _ in blocks), "confidence": mean, "metadata": {"has_text_layer": "false"}}


def parse_files(files: DataFrame, parsers: list) -> DataFrame:
    """Page rows of files(path, content) by the first parser that supports each path."""

    def run(frames):
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = PurePosixPath(path).stem
                base = {"path": path, "doc_name": name, "page_number": None, "text": None, "metadata": {}, "confidence": None, "warning": None, "error": None}
                try:
                    parser = next((p for p in parsers if p.supports(path)), None)
                    if parser is None:
                        raise ValueError(f"no parser supports {PurePosixPath(path).suffix}")
                    rows += [base | page for page in parser.parse(path, content)]
                except Exception as e:  # one bad file must not end the job
                    rows.append(base | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=list(base)) if rows else pd.DataFrame({c: [] for c in ("path", "doc_name", "page_number", "text", "metadata", "confidence", "warning", "error")})

    return files.select("path", "content").mapInPandas(run, PAGES)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """(source_doc, doc_ord, pages, entities, relationships) of *_entities.json files."""
    from gridloom.operators.mentions import EXTRACTION

    raw = spark.read.schema(EXTRACTION).option("multiLine", True).option("pathGlobFilter", "*_entities.json").json(path).withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", r"([^/]+)_entities\.json$", 1)
    return raw.select(F.url_decode(name).alias("source_doc"), F.url_decode(name).alias("doc_ord"), F.lit(None).cast("array<int>").alias("pages"), "entities", "relationships")


#: The files of a gold standard and the columns that are read of them.
GOLD = {
    "entities": "id string, type string, canonical_name string, aliases array<string>, ambiguous_surfaces array<string>",
    "relations": "`from` string, type string, `to` string, attributes map<string,string>, documents array<string>",
    "occurrences": "document string, page int, entity_id string, surface string",
    "documents": "name string, file string, format string, pages int",
    "questions": "id string, type string, question string, answer_type string, answer string, evidence_entities array<string>, evidence_paths array<array<array<string>>>, min_documents int, documents_needed array<string>, priority bigint",
}


def read_gold(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a gold standard kept as <table>.json files of JSON arrays; answers are given as their JSON text."""
    return {name: spark.read.schema(schema).option("multiLine", True).json(f"{path}/{name}.json") for name, schema in GOLD.items()}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(document, text) of .txt and .md files as they are, and of .json files with a `pages` list of strings or objects."""
    plain = spark.read.option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    strings = F.from_json(F.get_json_object("value", "$.pages"), "array<string>")
    objects = F.from_json(F.get_json_object("value", "$.pages"), "array<struct<text string, content string>>")
    page = F.transform(objects, lambda p: F.coalesce(F.nullif(p["text"], F.lit("")), p["content"], F.lit("")))
    is_object = F.get_json_object("value", "$.pages[0]").startswith("{")
    json = raw.select("file", F.array_join(F.when(is_object, page).otherwise(strings), "\n").alias("text"))
    stem = F.url_decode(F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1))
    return plain.unionByName(json).select(stem.alias("document"), "text").where("text is not null")


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The last path, in order of name, that matches a pattern."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return max((str(s.getPath()) for s in found), default=None) if found else None


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph written by write_graphml: one element a line."""
    lines = spark.read.text(path)
    data = lambda: F.map_from_arrays(F.regexp_extract_all("value", F.lit(r'<data key="([^"]*)">'), F.lit(1)), F.transform(F.regexp_extract_all("value", F.lit(r'<data key="[^"]*">([^<]*)</data>'), F.lit(1)), _unescape))
    n = lines.where(F.trim("value").startswith("<node ")).select(_unescape(F.regexp_extract("value", r'id="([^"]*)"', 1)).alias("node_id"), data().alias("attrs"))
    e = lines.where(F.trim("value").startswith("<edge ")).select(_unescape(F.regexp_extract("value", r'source="([^"]*)"', 1)).alias("src"), _unescape(F.regexp_extract("value", r'target="([^"]*)"', 1)).alias("dst"), data().alias("attrs"))
    return n, e


def _unescape(c):
    for a, b in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#10;", "\n"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


STEM = re.compile(r"([^/]+)\.[^./]+$")
