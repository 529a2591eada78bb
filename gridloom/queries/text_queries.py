"""Queries on text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.operators.retrieve import chunks
from gridloom.session import table


def normalize_name(spark, d):
    return table(spark, d, "occurrences").select("occurrence_id", text.normalize_name(F.col("surface")).alias("norm"))


def token_sort(spark, d):
    return table(spark, d, "occurrences").select("occurrence_id", text.token_sort(F.lower("surface")).alias("sorted"))


def token_jaccard(spark, d):
    e = table(spark, d, "entities").select(F.col("unique_entity_id").alias("entity_id"), "canonical_name", "load_seq").groupBy("entity_id").agg(F.max_by("canonical_name", "load_seq").alias("name"))
    o = table(spark, d, "occurrences").join(e, "entity_id")
    return o.select("occurrence_id", F.round(text.token_jaccard(F.col("surface"), F.col("name")), 6).alias("jaccard"))


def text_quality(spark, d):
    return table(spark, d, "rapidocr_pages").select("page_id", F.round(text.text_quality(F.col("text"), F.col("ocr_confidence")), 4).alias("quality"))


def token_estimate(spark, d):
    return table(spark, d, "rapidocr_pages").select("page_id", text.token_estimate(F.col("text"), ~F.col("has_text_layer")).cast("bigint").alias("n_tokens"))


def clean_lines(spark, d):
    return table(spark, d, "rapidocr_pages").select("page_id", F.md5(text.clean_lines(F.col("text"))).alias("cleaned"))


def parse_numbers(spark, d):
    n = text.parse_numbers(F.col("text"))
    return table(spark, d, "rapidocr_pages").select("page_id", F.size(n).cast("bigint").alias("n_numbers"), F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


def chunk_windows(spark, d):
    c = chunks(table(spark, d, "documents"), "doc_id", F.col("text"))
    return c.select(F.col("document").alias("doc_id"), F.col("chunk").cast("bigint").alias("chunk"), F.md5("text").alias("digest"))


def retrieval_tokens(spark, d):
    t = table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"))


def answer_reading(spark, d):
    t = table(spark, d, "occurrences").select("occurrence_id", text.yes_no(F.col("surface")).alias("reading"), text.is_abstention(F.col("surface")).alias("abstains"))
    return t


def entity_texts(spark, d):
    e = table(spark, d, "entities")
    role = F.get_json_object("attributes", "$.role")
    return e.select("load_seq", text.entity_text(F.col("entity_type"), F.col("canonical_name"), role).alias("embedded"))


def embedding_lines(spark, d):
    e = table(spark, d, "entities")
    return e.select("load_seq", text.embedding_text(["unique_entity_id", "entity_type", "canonical_name", "cluster_size"]).alias("embedded"))


def json_props(spark, d):
    p = F.from_json("props", "map<string,string>")
    e = table(spark, d, "events").select("event_type", F.explode(F.map_keys(p)).alias("name"))
    return e.groupBy("event_type", "name").agg(F.count("*").alias("n"))


_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower(coalesce({c}, '')), '\bm/s\.?', ' ', 'g'), '&', ' and '),
  '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g'), '[.''’-]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"""
_TITLES = "['mr','mrs','ms','dr','shri','smt','messrs','miss','']"
_LEGAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\bprivate limited\b', 'pvt ltd', 'g'), '\bprivate ltd\b', 'pvt ltd', 'g'), '\bpvt limited\b', 'pvt ltd', 'g'), '\blimited\b', 'ltd', 'g')"


def norm_sql(c: str) -> str:
    """The normalised name of a column, in DuckDB."""
    kept = f"array_to_string(list_filter(string_split({_NORM.format(c=c)}, ' '), lambda t: NOT list_contains({_TITLES}, t)), ' ')"
    return _LEGAL.format(x=kept)


_WORDS = r"list_filter(regexp_split_to_array({c}, '\s+'), lambda t: t <> '')"

QUERIES = {f.__name__: f for f in (
    normalize_name, token_sort, token_jaccard, text_quality, token_estimate, clean_lines, parse_numbers, chunk_windows, retrieval_tokens, answer_reading, entity_texts, embedding_lines, json_props)}
SQL = {
    "entity_texts": """SELECT load_seq, coalesce(nullif(concat_ws(' | ', CASE WHEN trim(entity_type) <> '' THEN 'Type: ' || entity_type END, CASE WHEN trim(canonical_name) <> '' THEN 'Name: ' || canonical_name END,
      CASE WHEN json_valid(attributes) AND trim(json_extract_string(attributes, '$.role')) <> '' THEN 'Role: ' || json_extract_string(attributes, '$.role') END), ''), 'Unknown Entity') AS embedded FROM entities""",
    "normalize_name": f"SELECT occurrence_id, {norm_sql('surface')} AS norm FROM occurrences",
    "token_sort": f"SELECT occurrence_id, array_to_string(list_sort({_WORDS.format(c='coalesce(lower(surface), chr(32))')}), ' ') AS sorted FROM occurrences",
    "token_jaccard": f"""WITH e AS (SELECT unique_entity_id AS entity_id, arg_max(canonical_name, load_seq) AS name FROM entities GROUP BY 1),
      w AS (SELECT occurrence_id, list_distinct({_WORDS.format(c='lower(surface)')}) AS x, list_distinct({_WORDS.format(c='lower(name)')}) AS y FROM occurrences JOIN e USING (entity_id))
      SELECT occurrence_id, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0.0 END, 6) AS jaccard FROM w""",
    "text_quality": rf"""WITH w AS (SELECT page_id, text, ocr_confidence, {_WORDS.format(c='text')} AS ws, length(text) AS n FROM rapidocr_pages)
      SELECT page_id, round(CASE WHEN len(ws) > 0 THEN least(1.0, greatest(0.0, 0.4 * coalesce(ocr_confidence, 0.5) + 0.3 * length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) / n
        + 0.2 * (1 - length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) / n) + 0.1 * CASE WHEN list_sum(list_transform(ws, lambda x: length(x))) / len(ws) BETWEEN 3 AND 10 THEN 1.0 ELSE 0.5 END)) ELSE 0.0 END, 4) AS quality FROM w""",
    "token_estimate": "SELECT page_id, (length(text) // 4 + CASE WHEN NOT has_text_layer THEN 3500 ELSE 0 END)::BIGINT AS n_tokens FROM rapidocr_pages",
    "clean_lines": r"SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS cleaned FROM rapidocr_pages",
    "chunk_windows": f"""WITH w AS (SELECT doc_id, {_WORDS.format(c='text')} AS ws FROM documents),
      s AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 20, 1), 80)) AS i FROM w WHERE len(ws) > 0)
      SELECT doc_id, i // 80 AS chunk, md5(array_to_string(ws[i + 1 : i + 100], ' ')) AS digest FROM s""",
    "retrieval_tokens": "WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.&''-][a-z0-9]+)*')) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY 1",
    "answer_reading": f"""WITH n AS (SELECT occurrence_id, {norm_sql('surface')} AS s FROM occurrences), t AS (SELECT *, string_split(s, ' ') AS w FROM n)
      SELECT occurrence_id, CASE WHEN w[1] IN ('yes', 'no') THEN w[1] WHEN list_has_any(w, ['not', 'no', 'neither']) THEN 'no' WHEN list_contains(w, 'yes') THEN 'yes' END AS reading,
        s = '' OR regexp_matches(s, '^(not found|unknown|i dont know|i do not know|no answer|cannot be determined|not mentioned|not stated|not available)') AS abstains FROM t""",
    "embedding_lines": """SELECT load_seq, concat_ws(chr(10), 'unique_entity_id: ' || unique_entity_id, 'entity_type: ' || entity_type, 'canonical_name: ' || canonical_name, 'cluster_size: ' || cluster_size) AS embedded FROM entities""",
    "json_props": "WITH k AS (SELECT event_type, unnest(json_keys(props)) AS name FROM events) SELECT event_type, name, count(*) AS n FROM k GROUP BY ALL",
}
