"""Packing pages for a model, asking it, and reading what it returns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import token_estimate
from gridloom.operators.mentions import EXTRACTION

BUDGET, PROMPT = 250_000, 2_000


def pack_pages(pages: DataFrame, budget: int = BUDGET, instruction: int = PROMPT) -> DataFrame:
    """(doc_name, page_number, n_tokens, chunk): pages in order, a new chunk when the next page would pass the budget.

    pages(doc_name, page_number, n_tokens). The instruction is paid per chunk; a page is never split, and one beyond the
    budget stands alone. A running sum that starts again has no window form, so pages stream through one pass over
    sorted partitions that keeps two numbers; nothing of a document is gathered.
    """

    def run(frames):
        doc, chunk, used = None, 0, 0
        for pdf in frames:
            out = []
            for name, n in zip(pdf["doc_name"], pdf["n_tokens"], strict=True):
                if name != doc:
                    doc, chunk, used = name, 1, instruction
                elif used + n > budget and used > instruction:
                    chunk, used = chunk + 1, instruction
                used += n
                out.append(chunk)
            yield pdf.assign(chunk=out)

    ordered = pages.select("doc_name", F.col("page_number").cast("int").alias("page_number"), F.col("n_tokens").cast("bigint").alias("n_tokens")).repartition("doc_name").sortWithinPartitions("doc_name", "page_number")
    return ordered.mapInPandas(run, "doc_name string, page_number int, n_tokens bigint, chunk int")


def page_tokens(pages: DataFrame, text: str = "text", has_image: str | None = None) -> DataFrame:
    image = ~F.col(has_image) if has_image else F.lit(False)
    return pages.select("doc_name", "page_number", token_estimate(F.col(text), image).cast("bigint").alias("n_tokens"))


def repair_json(reply: str):
    """The object in a reply: inside a fence if there is one, strictly if that parses, else with its end closed; None if hopeless."""
    fenced = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", reply or "", re.S)
    body = (fenced.group(1) if fenced else reply or "").strip()
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = body[start:]
    try:
        return json.JSONDecoder().raw_decode(body)[0]
    except ValueError:
        pass
    body = re.sub(r",\s*([}\]])", r"\1", body)
    for end in [len(body), *[m.end() for m in re.finditer(r"[}\]]", body)][::-1]]:  # cut back to what can be closed
        piece, open_, text, escaped = body[:end], [], False, False
        for ch in piece:
            if text:
                escaped, text = (ch == "\\" and not escaped), not (ch == '"' and not escaped)
            elif ch == '"':
                text = True
            elif ch in "{[":
                open_.append("}" if ch == "{" else "]")
            elif ch in "}]" and open_:
                open_.pop()
        tail = ('"' if text else "") + "".join(reversed(open_))
        try:
            return json.loads(re.sub(r"[,:]\s*$", "", piece) + tail)
        except ValueError:
            continue
    return None


def extract(requests: DataFrame, ask: Callable[[str], str], retries: int = 1, least_text: int = 200) -> DataFrame:
    """(doc_name, chunk, entities, relationships, error) of requests(doc_name, chunk, text).

    A reply is asked for again, at most `retries` times, when it is empty, unreadable, or names no entity although the text
    has at least `least_text` characters; what fails for good is an empty result with its error.
    """

    def run(frames):
        for pdf in frames:
            rows = []
            for doc, chunk, text in zip(pdf["doc_name"], pdf["chunk"], pdf["text"], strict=True):
                result, error = None, None
                for _ in range(1 + retries):
                    try:
                        reply = ask(text)
                        result, error = repair_json(reply), None
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        continue
                    if isinstance(result, dict) and (result.get("entities") or len(text) < least_text):
                        break
                if not isinstance(result, dict):
                    result, error = {}, error or "unreadable reply"
                rows.append((doc, chunk, json.dumps({k: result.get(k) or [] for k in ("entities", "relationships")}), error))
            yield pd.DataFrame(rows, columns=["doc_name", "chunk", "reply", "error"])

    out = requests.select("doc_name", "chunk", "text").mapInPandas(run, "doc_name string, chunk int, reply string, error string")
    return out.select("doc_name", "chunk", F.from_json("reply", EXTRACTION).alias("r"), "error").select("doc_name", "chunk", "r.entities", "r.relationships", "error")
