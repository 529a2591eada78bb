"""Noise in text from scanned pages: furniture, broken words and misread characters.

Lines at page edges are compared with the lines at the same edge of the pages around them; a boosted classifier of such
line pairs decides every edge line. Whether a word broken at a line end goes on in the next line is decided by a second
boosted classifier of line pairs, over corpus counts of the joined word, the compound and the two pieces. For
misread words candidates come from joins on positional character q-grams, among the words common in the corpus,
among words the same document writes more often, and among names of other documents; words with signs or digits in them
get in addition their readings by the confusion table. Boosted rankings over counts, confusion costs, letter
statistics and shapes choose the replacement or keep the word.

Rules only label what the models learn from: lines that clearly repeat or clearly run on, known words broken at some letter,
known words and numbers misread by the table, and of every common word and name the three that share the most q-grams with
it. Models, letter statistics, counts, candidates and decisions cover all lines and words. What differs from word to word
in the training rows is drawn by the word itself.

Limits of what counts as misread: a word of four letters or more (or of capitals), at most MOST_CONFUSIONS confusions of the
table from what was meant, which is in the corpus; in names of other documents the join loses no single confusion from five
letters on. Tokens of more than LONGEST characters are no words.

Context is taken from neighbouring pages by equality joins on (document, page number), and words are counted per
(document, word) with partial aggregation, so a document with a third of all pages makes no large task. Every join of
two tables is a merge join; only the classifiers and the counts of letter trigrams are broadcast.

Defined results: null texts have no lines; blank lines are never noise; a page alone in its document is judged by its
own lines; repeated pages are judged each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridloom.llm.boosting import Boosted
from gridloom.session import Scratch, Stage, merge_join

COMMON, RARE = 0.003, 0.15
MARKS = "-‐¬­"
#: What scanners read (right) for what was printed (left).
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("i", "l"), ("l", "i"), ("i", "!"), ("i", "|"), ("l", "|"), ("l", "1"), ("i", "1"), ("I", "l"), ("o", "0"), ("O", "0"),
    ("s", "5"), ("S", "5"), ("a", "@"), ("t", "†"), ("g", "9"), ("q", "9"), ("b", "6"), ("B", "8"), ("Z", "2"), ("z", "2"), ("m", "rn"), ("rn", "m"),
    ("d", "cl"), ("cl", "d"), ("w", "vv"), ("vv", "w"), ("n", "ri"), ("ri", "n"), ("in", "m"), ("m", "in"), ("nn", "rm"), ("u", "ii"), ("ii", "u"),
    ("h", "li"), ("li", "h"), ("ti", "h"), ("h", "b"), ("b", "h"), ("v", "y"), ("y", "v"), ("fi", "ﬁ"), ("ff", "ﬀ"), ("fl", "ﬂ"), ("N", "H"), ("H", "N"),
    ("R", "P"), ("P", "R"), ("E", "F"), ("F", "E"), ("G", "C"), ("C", "G"), ("D", "O"), ("O", "D"), ("u", "v"), ("n", "u"), ("u", "n"), ("f", "t"), ("t", "f"), ("tt", "ft"),
)

# ---------------------------------------------------------------- lines and furniture


def _fold(line: Column) -> Column:
    """A line with numbers, also roman and misread ones, as #, in lower case."""
    s = F.lower(F.trim(line))
    s = F.regexp_replace(s, r"\b[0-9][0-9oilsz|!]*\b|\b[oilsz|!]{1,2}[0-9]+\b", "#")
    return F.regexp_replace(s, r"\b[ivxl|1]{1,6}\b", "#")


def _is_page_number(line: Column) -> Column:
    s = F.regexp_replace(F.lower(line), r"\bp\s*a\s*g\s*[ec]\b|\bpage\b|\bpagc\b|\bp\b|\bof\b|[^\p{L}\p{N}|!]", "")
    return s.rlike(r"^(?:[0-9oilszbgq|!]{1,5}|[ivxlc|!1]{1,7}|[0-9]{1,6})$") & (F.length(F.trim(line)) <= 22)


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, doc, page, line_no, line, from_top, from_bottom, widest, gap): non-blank lines with their place."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    filled = F.filter(numbered, lambda x: x["line"].rlike(r"(?U)\S"))
    base = pages.where("text is not null").select(
        "page_id", F.col("doc_name").alias("doc"), F.col("page_number").cast("bigint").alias("page"), filled.alias("ls")
    )
    widest = F.aggregate("ls", F.lit(0), lambda a, x: F.greatest(a, F.length(x["line"])))
    each = base.select("page_id", "doc", "page", widest.alias("widest"), F.size("ls").alias("n"), F.posexplode("ls").alias("pos", "l"), F.transform("ls", lambda x: x["line_no"]).alias("nos"))
    before = F.col("l.line_no") - F.try_element_at("nos", F.col("pos"))
    after = F.try_element_at("nos", F.col("pos") + 2) - F.col("l.line_no")
    return each.select(
        "page_id", "doc", "page", F.col("l.line_no").alias("line_no"), F.rtrim(F.regexp_replace("l.line", "\r", "")).alias("line"),
        F.col("pos").alias("from_top"), (F.col("n") - 1 - F.col("pos")).alias("from_bottom"), "widest",
        (F.when(F.col("pos") > 0, before > 1).otherwise(False)).alias("gap_before"), (F.when(F.col("pos") < F.col("n") - 1, after > 1).otherwise(False)).alias("gap_after"),
    )


_LINE_FEATURES = ["shorter", "stops", "low_start", "caps", "titles", "barred", "digits", "gap", "words", "docs", "number"]
#: What the pair of a line and its likeness on the pages around adds.
_PAIR_FEATURES = ["repeat", "depth"]


def _edge_lines(lines: DataFrame, depth: tuple[int, int], scratch: Scratch, beside: DataFrame | None = None) -> DataFrame:
    """The lines so deep from the top or bottom of their page, with their features and the best likeness to a neighbour's.

    beside(page_id, edge): only those edges of pages.
    """
    edge = lines.withColumn("edge", F.when(F.col("from_top") <= F.col("from_bottom"), "t").otherwise("b")).withColumn("depth", F.least("from_top", "from_bottom")).where(F.col("depth").between(*depth))
    if beside is not None:
        edge = merge_join(edge, beside, ["page_id", "edge"], "left_semi")
    line = F.trim("line")
    words = F.split(line, r"\s+")
    edge = edge.withColumn("fold", _fold(F.col("line"))).select(
        "page_id", "doc", "page", "line_no", "edge", "fold", "depth",
        (F.length(line) / F.greatest("widest", F.lit(1))).alias("shorter"),
        line.rlike(r"[.,;:]$").cast("double").alias("stops"),
        line.rlike(r"^\p{Ll}").cast("double").alias("low_start"),
        (F.upper(line) == line).cast("double").alias("caps"),
        (F.size(F.filter(words, lambda w: w.rlike(r"^[\p{Lu}\p{N}\[(&|/-]"))) / F.size(words)).alias("titles"),
        line.rlike(r"[|/]\s").cast("double").alias("barred"),
        (F.length(F.regexp_replace(line, r"\P{N}", "")) / F.length(line)).alias("digits"),
        F.when(F.col("edge") == "t", F.col("gap_after")).otherwise(F.col("gap_before")).cast("double").alias("gap"),
        F.size(words).cast("double").alias("words"),
        _is_page_number(line).cast("double").alias("number"),
    )
    edge = scratch.stage(edge, "edges")
    docs = edge.select("fold", "doc").distinct().groupBy("fold").agg(F.log2(F.count("*")).alias("docs"))
    there = edge.select("doc", "edge", F.col("page").alias("near"), F.col("fold").alias("their_fold")).distinct()
    asks = edge.select("page_id", "line_no", "doc", "edge", "fold", F.explode(F.array(*[F.col("page") + F.lit(i) for i in (-2, -1, 1, 2)])).alias("near"))
    like = 1 - F.levenshtein("fold", "their_fold") / F.greatest(F.length("fold"), F.length("their_fold"), F.lit(1))
    repeat = merge_join(asks, there, ["doc", "edge", "near"]).groupBy("page_id", "line_no").agg(F.max(like).alias("repeat"))
    return scratch.stage(merge_join(merge_join(edge, docs, "fold"), repeat, ["page_id", "line_no"], "left").na.fill(0.0, ["repeat"]), "judged")


def _known_furniture() -> tuple[Column, Column]:
    """What is furniture, and what is not, beyond doubt: the labels of the training sample."""
    yes = ((F.col("repeat") >= 0.85) & ((F.col("stops") == 0) | (F.col("digits") > 0.2))) | ((F.col("number") == 1) & (F.col("depth") == 0))
    no = ~yes & (F.col("repeat") < 0.6) & ((F.col("stops") == 1) | (F.col("low_start") == 1) | ((F.col("shorter") > 0.85) & (F.col("barred") == 0) & (F.col("caps") == 0) & (F.col("digits") < 0.2)))
    return yes, no


def _furniture_model(edges: DataFrame) -> Boosted:
    """A classifier of line pairs. A first one learns the labels from the line alone; a second one learns those labels, and
    the first one's judgement of the lines that have none, from the line and its likeness to its neighbours."""
    yes, no = _known_furniture()
    rows = edges.select(*_LINE_FEATURES, *_PAIR_FEATURES, F.when(yes, 1.0).when(no, 0.0).otherwise(-1.0).alias("label"))
    alone = Boosted().fit_rows(rows.where("label >= 0 and depth = 0"), _LINE_FEATURES)
    sent = edges.sparkSession.sparkContext.broadcast(alone)

    @F.pandas_udf(DoubleType())
    def guess(*cols: pd.Series) -> pd.Series:
        return pd.Series(sent.value.predict(np.stack([c.to_numpy(float) for c in cols], axis=1)))

    # a line behind the outermost one must be told with more certainty
    told = (guess(*_LINE_FEATURES) >= F.when(F.col("depth") == 0, 0.5).otherwise(0.9)).cast("double")
    every = rows.withColumn("label", F.when(F.col("label") >= 0, F.col("label")).otherwise(told))
    return Boosted(rounds=100, depth=4).fit_rows(every, _LINE_FEATURES + _PAIR_FEATURES)


def furniture(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, line_no) of headers, footers and page numbers.

    A line behind the outermost one is furniture only if all before it are; lines deeper than the second are judged on
    the pages where that holds, one more at a time, as deep as it goes.
    """
    edges = _edge_lines(lines, (0, 1), scratch)
    sent = edges.sparkSession.sparkContext.broadcast(_furniture_model(edges))

    @F.pandas_udf(DoubleType())
    def chance(*cols: pd.Series) -> pd.Series:
        return pd.Series(sent.value.predict(np.stack([c.to_numpy(float) for c in cols], axis=1)))

    key = ["page_id", "line_no"]
    judged = scratch.stage(edges.withColumn("p", chance(*_LINE_FEATURES, *_PAIR_FEATURES)).where("p >= 0.5").select(*key, "edge", "depth"), "judged")
    first = judged.where("depth = 0")
    second = scratch.stage(merge_join(judged.where("depth = 1"), first.select("page_id", "edge").distinct(), ["page_id", "edge"], "left_semi"), "second")
    out, depth, last = first.select(*key).unionByName(second.select(*key)), 2, second
    while last.limit(1).count():
        deeper = _edge_lines(lines, (depth, depth), scratch, last.select("page_id", "edge").distinct()).withColumn("depth", F.lit(1))
        last = scratch.stage(deeper.withColumn("p", chance(*_LINE_FEATURES, *_PAIR_FEATURES)).where("p >= 0.5").select(*key, "edge"), "deeper")
        out, depth = out.unionByName(last.select(*key)), depth + 1
    return out.distinct()


# ---------------------------------------------------------------- broken words


#: Pages that one window may hold when the next page with running text is sought.
_BLOCK = 1000


def running_lines(lines: DataFrame, noise: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Lines of the running text with the line that follows, on the same page or on the next one that has any.

    The next page is found inside blocks of _BLOCK page numbers, and beyond a block's end as the first one of the next block
    that holds any, so a document of any length makes no large window.
    """
    # lines are shuffled once: those of one page meet their noise and their neighbours in the same partition
    out = noise.groupBy("page_id").agg(F.collect_set("line_no").alias("out"))
    run = merge_join(lines.select("page_id", "doc", "page", "line_no", "line"), out, "page_id", "left").where("out is null or not array_contains(out, line_no)").drop("out")
    w = Window.partitionBy("page_id").orderBy("line_no")
    run = run.withColumn("after", F.lead(F.struct(F.col("page_id").alias("page_id"), "line_no", "line")).over(w))
    run = scratch.stage(run, "followed") if scratch else run
    head = run.where("page is not null").groupBy("doc", "page").agg(F.min(F.struct("page_id", "line_no", "line")).alias("head")).withColumn("block", F.floor(F.col("page") / _BLOCK))
    inside = head.withColumn("ahead", F.lead("head").over(Window.partitionBy("doc", "block").orderBy("page")))
    blocks = head.groupBy("doc", "block").agg(F.min_by("head", "page").alias("first"))
    blocks = blocks.withColumn("beyond", F.lead("first").over(Window.partitionBy("doc").orderBy("block"))).drop("first")
    ahead = merge_join(inside, blocks, ["doc", "block"]).select("doc", "page", F.coalesce("ahead", "beyond").alias("ahead"))
    # only the last line of a page is joined with the next page
    ends = merge_join(run.where("after is null"), ahead, ["doc", "page"], "left")
    columns = ["page_id", "doc", "page", "line_no", "line"]
    return run.where("after is not null").select(*columns, F.col("after").alias("next")).unionByName(ends.select(*columns, F.col("ahead").alias("next")))


_OUTER = r"^[.,;:()\[\]\"']+|[.,;:()\[\]\"']+$"


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, _OUTER, "")


def _log1p(c: str) -> Column:
    return F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double"))


def broken_words(run: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, line_no, next_page, next_line, left, right, mark, broken) of lines that end within a word.

    broken is true where the mark does not belong to the word, false for compounds.
    """
    last = F.substring_index("line", " ", -1)
    mark = F.expr("right(line, 1)")
    cut = run.where(mark.isin(*MARKS) & F.col("next").isNotNull()).withColumn("mark", mark).withColumn("left", F.regexp_replace(F.substring(last, F.lit(1), F.length(last) - 1), r"^[.,;:()\[\]\"']+", ""))
    cut = cut.where((F.col("left") != "") & ~F.expr("right(left, 1)").isin(*MARKS)).withColumn("right", F.regexp_replace(F.element_at(F.split(F.trim("next.line"), r"\s+"), 1), r"[.,;:()\[\]\"']+$", ""))
    cut = scratch.stage(cut.where("right <> ''").select("page_id", "line_no", F.col("next.page_id").alias("next_page"), F.col("next.line_no").alias("next_line"), "left", "right", "mark"), "cut")
    types = scratch.stage(_types(run, cut).groupBy("token").agg(F.count("*").alias("docs")), "types")
    rows = cut.withColumn("label", F.lit(-1.0)).unionByName(_broken_samples(types), allowMissingColumns=True)
    pieces = {"joined": F.concat("left", "right"), "compound": F.concat("left", F.lit("-"), "right"), "l": F.col("left"), "r": F.col("right")}
    for name, text in pieces.items():
        rows = merge_join(rows.withColumn("token", text), types.withColumnRenamed("docs", name), "token", "left").drop("token")
    letters = F.col("right").rlike(r"^[\p{Ll}!|†@0-9ﬁﬀ]") & F.col("left").rlike(r"[\p{L}!|†@0-9ﬁﬀ]$")
    code = F.col("right").rlike(r"^[0-9]+$") | F.col("left").rlike(r"^[0-9]+$")
    keep = ["page_id", "line_no", "next_page", "next_line", "left", "right", "mark"]
    rows = scratch.stage(rows.select(*keep, "label", *[_log1p(c).alias(f"f{i}") for i, c in enumerate(pieces)], (F.col("mark") != "-").cast("double").alias("f4"), (letters & ~code).cast("double").alias("f5")), "pieces")
    sent = run.sparkSession.sparkContext.broadcast(_break_model(rows.where("label >= 0")))

    @F.pandas_udf(DoubleType())
    def chance(*cols: pd.Series) -> pd.Series:
        return pd.Series(sent.value.predict(np.stack([c.to_numpy(float) for c in cols], axis=1)))

    return rows.where("label < 0").withColumn("p", chance(*[f"f{i}" for i in range(6)])).select(*keep, (F.col("p") >= 0.5).alias("broken"))


def _broken_samples(types: DataFrame) -> DataFrame:
    """(left, right, mark, label): known words broken at some letter (1) and known compounds taken apart (0)."""
    known = types.where("docs >= 2 and length(token) between 5 and 40").where(F.col("token").rlike(r"^\p{L}+(-\p{L}+)?$"))
    dash = F.locate("-", F.col("token"))
    at = 2 + F.pmod(F.xxhash64("token"), F.length("token") - 3).cast("int")
    cut = known.select("token", dash.alias("dash"), at.alias("at"))
    left, right = F.expr("substr(token, 1, if(dash > 0, dash - 1, at))"), F.expr("substr(token, if(dash > 0, dash, at) + 1)")
    return cut.select(left.alias("left"), right.alias("right"), F.lit("-").alias("mark"), (F.col("dash") == 0).cast("double").alias("label"))


def _break_model(rows: DataFrame) -> Boosted:
    """Trained on the samples with their counts, each also as if it were unseen itself."""
    with Scratch() as scratch:
        seen = scratch.stage(rows.groupBy(*[f"f{i}" for i in range(4)], "label").agg(F.count("*").alias("n")), "samples")
        size = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        # a corpus has few compounds: as seen, each counts as often as makes both classes equal
        often = max(1, size.get(1.0, 0) // max(1, size.get(0.0, 0)))
        compound = F.col("label") == 0
        unseen = seen.withColumn("f1", F.when(compound, 0.0).otherwise(F.col("f1"))).withColumn("f0", F.when(compound, F.col("f0")).otherwise(0.0))
        both = seen.withColumn("n", F.when(compound, F.col("n") * often).otherwise(F.col("n"))).unionByName(unseen)
        # the hyphen also stands in words and codes; pieces that cannot be of one word were not broken; other marks belong to no word
        kind = lambda mark, ok, label: F.struct(F.lit(mark).alias("f4"), F.lit(ok).alias("f5"), label.alias("y"))
        kinds = F.array(kind(0.0, 1.0, F.col("label")), kind(0.0, 0.0, F.lit(0.0)), kind(1.0, 0.0, F.lit(1.0)), kind(1.0, 1.0, F.lit(1.0)))
        return Boosted(rounds=60, depth=4).fit_rows(both.select(*[f"f{i}" for i in range(4)], "n", F.inline(kinds)), [f"f{i}" for i in range(6)], "y", "n")


# ---------------------------------------------------------------- words


def _types(run: DataFrame, cut: DataFrame) -> DataFrame:
    """(doc, token) with the count of each whole word of the running text, without the pieces at broken line ends."""
    return tokens_of(run, cut).where("next_page is null").groupBy("doc", "token").agg(F.count("*").alias("n"))


def tokens_of(run: DataFrame, cut: DataFrame, place: bool = False) -> DataFrame:
    """(page_id, line_no, doc, token, left, next_page, next_line): the words of each line.

    cut(page_id, line_no, next_page, next_line, left, right[, broken]): a word that goes over a line end is one token of
    the line it starts in, with both its lines; left is the part in the first line. place adds the position in the line and
    the punctuation before and behind the bare token.
    """
    whole = "broken" in cut.columns
    word = F.concat(F.col("left"), F.when(F.col("broken"), "").otherwise("-") if whole else F.lit("-"), F.col("right"))
    ends = cut.select("page_id", "line_no", "next_page", "next_line", "left", word.alias("word"))
    starts = cut.select(F.col("next_page").alias("page_id"), F.col("next_line").alias("line_no"), F.lit(True).alias("begun")).distinct()
    key = ["page_id", "line_no"]
    rows = merge_join(merge_join(run.select(*key, "doc", "line"), ends, key, "left"), starts, key, "left")
    toks = F.split(F.trim("line"), r"\s+")
    first = F.when(F.col("begun"), 2).otherwise(1)
    kept = F.slice(toks, first, F.greatest(F.size(toks) - first + 1 - F.when(F.col("word").isNotNull(), 1).otherwise(0), F.lit(0)))
    none = F.lit(None)
    plain = F.transform(kept, lambda t: F.struct(_bare(t).alias("token"), none.cast("string").alias("left"), none.cast("bigint").alias("next_page"), none.cast("int").alias("next_line")))
    over = F.when(F.col("word").isNotNull(), F.array(F.struct(_bare(F.col("word")).alias("token"), F.col("left"), F.col("next_page").cast("bigint").alias("next_page"), F.col("next_line").cast("int").alias("next_line")))).otherwise(
        F.array().cast("array<struct<token:string,left:string,next_page:bigint,next_line:int>>")
    )
    if place:
        raw = F.concat(kept, F.when(F.col("word").isNotNull(), F.array("word")).otherwise(F.array().cast("array<string>")))
        each = rows.select("page_id", "line_no", "doc", F.posexplode(raw).alias("at", "raw"))
        before = F.regexp_extract("raw", r"^([.,;:()\[\]\"']*)", 1)
        token = _bare(F.col("raw"))
        behind = F.expr("substr(raw, length(before) + length(token) + 1)")
        return each.withColumn("before", before).withColumn("token", token).withColumn("behind", behind)
    return rows.select("page_id", "line_no", "doc", F.inline(F.concat(plain, over))).where("token <> ''")


_CODE = r"^(?:[A-Z]{1,3}[-/]?[0-9]+(?:/[0-9]+)*|[0-9]+(?:st|nd|rd|th)|[0-9][0-9.,/:%-]*|[A-Z]?[0-9]+(?:[-/][0-9]+)*)$"


#: Letters that scanners give for signs and digits, and digits for letters and signs.
_AS_LETTERS = ("!|†@0156982", "iltaolsbgBz")
_AS_DIGITS = ("OolI|!SsZzBGbgq", "001111552286699")
_MIXED = r"[!|†@ﬀ-ﬆ]|\p{L}.*[0-9]|[0-9].*\p{L}"
_READING = ["as_number", "signs", "digits", "letters", "changed", "length", "seen_docs", "meant_docs", "seen_shape", "meant_shape", "shapes", "plain_word", "plain_number"]


def _shape(token: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(token, "[0-9]", "9"), r"\p{Lu}", "A")
    return F.regexp_replace(s, r"\p{Ll}+", "a")


def _readings(tokens: DataFrame, totals: DataFrame, shapes: DataFrame) -> DataFrame:
    """(token, truth, meant, features): every token(token, truth) read as letters and read as a number.

    truth is null for tokens of the corpus; what they add to its counts themselves is left out.
    """
    t = F.col("token")
    ligatures = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "ﬁ", "fi"), "ﬀ", "ff"), "ﬂ", "fl")
    both = F.array(F.struct(F.translate(ligatures, *_AS_LETTERS).alias("meant"), F.lit(0.0).alias("as_number")), F.struct(F.translate(t, *_AS_DIGITS).alias("meant"), F.lit(1.0).alias("as_number")))
    rows = tokens.where(t.rlike(_MIXED)).select("token", "truth", F.inline(both)).where("token <> meant")
    rows = rows.withColumn("seen_shape_of", _shape(t)).withColumn("meant_shape_of", _shape(F.col("meant")))
    rows = merge_join(rows, totals.select("token", F.col("docs").alias("seen_docs")), "token", "left")
    rows = merge_join(rows, totals.select(F.col("token").alias("meant"), F.col("docs").alias("meant_docs")), "meant", "left")
    rows = merge_join(rows, shapes.select(F.col("shape").alias("seen_shape_of"), F.col("docs").alias("seen_shape")), "seen_shape_of", "left")
    rows = merge_join(rows, shapes.select(F.col("shape").alias("meant_shape_of"), F.col("docs").alias("meant_shape")), "meant_shape_of", "left")
    own = F.col("truth").isNull()
    rows = rows.withColumn("seen_shape", F.col("seen_shape") - F.when(own, F.col("seen_docs")).otherwise(0)).withColumn("seen_docs", F.col("seen_docs") - F.when(own, 1).otherwise(0))
    share = lambda kind: F.length(F.regexp_replace(t, kind, "")) / F.length(t)
    counted = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    return rows.select(
        "token", "truth", "meant", "as_number",
        F.length(F.regexp_replace(t, r"[^!|†@ﬀ-ﬆ]", "")).cast("double").alias("signs"), share("[^0-9]").alias("digits"), share(r"\P{L}").alias("letters"),
        F.levenshtein("token", "meant").cast("double").alias("changed"), F.length(t).cast("double").alias("length"),
        *[counted(c).alias(c) for c in ("seen_docs", "meant_docs", "seen_shape", "meant_shape")], (counted("seen_shape") - counted("meant_shape")).alias("shapes"),
        F.col("meant").rlike(r"^\p{L}[\p{L}'-]*$").cast("double").alias("plain_word"), F.col("meant").rlike(r"^[0-9][0-9.,/:%-]*$").cast("double").alias("plain_number"),
        t.rlike(_CODE).alias("code"),
    )


def _misread_samples(totals: DataFrame, shapes: DataFrame) -> DataFrame:
    """(token, truth): every known word, number and code of a usual shape, misread by signs, letters and digits."""
    short = totals.where(F.length("token") <= LONGEST)
    kinds = {"word": (F.col("docs") >= 2) & F.col("token").rlike(r"^\p{L}{3,}$"), "number": F.col("token").rlike("^[0-9]") & F.col("token").rlike(_CODE) & ~F.col("token").rlike(r"\p{L}"), "code": F.col("token").rlike(_CODE) & F.col("token").rlike(r"\p{L}.*[0-9]")}
    signs = [(a, b) for a, b in CONFUSIONS if re.fullmatch(r"[!|†@0-9ﬁﬀﬂ]", b)]
    digits = [(d, x) for x, d in zip(*_AS_DIGITS, strict=True)]

    @F.pandas_udf(StringType())
    def scanned(token: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([_misread_once_or_twice(t, _drawn(t, 11), signs if w else digits, 0.3) for t, w in zip(token, word, strict=True)], dtype=object)

    usual = merge_join(short.where(kinds["code"]).withColumn("shape", _shape(F.col("token"))), shapes.where("docs >= 3").select("shape"), "shape", "left_semi")
    pool = short.where(kinds["word"]).select("token", F.lit(True).alias("word")).unionByName(short.where(kinds["number"]).unionByName(usual.select(short.columns)).select("token", F.lit(False).alias("word")))
    made = pool.select(scanned("token", "word").alias("seen"), F.col("token").alias("truth")).where("seen is not null and seen <> truth")
    return made.groupBy(F.col("seen").alias("token")).agg(F.max("truth").alias("truth"))


def _reading_model(rows: DataFrame) -> Boosted:
    """Misread samples against their wrong readings, and codes of the corpus as they are; each true one also as if it were unseen."""
    made = F.col("truth").isNotNull()
    usual = F.col("code") & (F.col("seen_shape") >= math.log(4)) & (F.col("shapes") >= math.log(0.05))
    seen = rows.where(made | usual).select(*_READING, F.coalesce((F.col("meant") == F.col("truth")).cast("double"), F.lit(0.0)).alias("label"))
    unseen = seen.where("label = 1").withColumn("meant_docs", F.lit(0.0))
    return Boosted(rounds=80, depth=4).fit_rows(seen.unionByName(unseen), _READING)


def sign_readings(totals: DataFrame) -> DataFrame:
    """(token, meant) of the tokens of totals(token, docs) that a sign, a letter or a digit makes unlike what was printed."""
    spark = totals.sparkSession
    with Scratch() as scratch:
        mixed = totals.where(F.col("token").rlike("[0-9!|†@ﬀ-ﬆ]") & (F.length("token") <= LONGEST))
        shapes = scratch.stage(mixed.groupBy(_shape(F.col("token")).alias("shape")).agg(F.sum("docs").alias("docs")), "shapes")
        made = _misread_samples(totals, shapes)
        rows = scratch.stage(_readings(mixed.select("token", F.lit(None).cast("string").alias("truth")).unionByName(made), totals, shapes), "readings")
        sent = spark.sparkContext.broadcast(_reading_model(rows))

        @F.pandas_udf(DoubleType())
        def chance(*cols: pd.Series) -> pd.Series:
            return pd.Series(sent.value.predict(np.stack([c.to_numpy(float) for c in cols], axis=1)))

        best = rows.where("truth is null").withColumn("p", chance(*_READING)).where("p >= 0.5").groupBy("token").agg(F.max(F.struct("p", "meant_docs", "meant")).alias("b"))
        return Stage(best.select("token", F.col("b.meant").alias("meant")), "read").df


def _grams(word: str, q: int) -> list[str]:
    w = f"^{word}$"
    return [f"{w[i : i + q]}{i}" for i in range(len(w) - q + 1)]


def _gram_rows(words: DataFrame, q: int, spread: bool) -> DataFrame:
    """One row per positional q-gram; spread adds the positions beside it."""
    w = F.concat(F.lit("^"), F.lower("token"), F.lit("$"))
    places = F.sequence(F.lit(1), F.greatest(F.length(w) - (q - 1), F.lit(1)))
    g = F.transform(places, lambda i: F.struct(F.substring(w, i, F.lit(q)).alias("gram"), i.alias("at")))
    rows = words.where(F.length("token") >= q - 1).select("*", F.inline(F.array_distinct(g)))
    if spread:
        rows = rows.withColumn("at", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)))
    return rows


def _by_first(table: tuple) -> dict[tuple[str, str], list[tuple[str, str]]]:
    out: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for a, b in table:
        out.setdefault((a[0], b[0]), []).append((a, b))
    return out


_TABLE = _by_first(CONFUSIONS)
#: A misread word holds at most so many confusions of the table and no other change; what differs more is another word.
MOST_CONFUSIONS = 3
#: A cost of 9 stands for all from there on: at most two edits outside the table, so ends lie at most so far apart.
_FAR, _BAND = 9, 8


def confusion_cost(seen: str, meant: str) -> float:
    """Least cost to read `meant` as `seen`: 1 for a known confusion, 4 for any other edit; at most 9."""
    n, m = len(meant), len(seen)
    if abs(n - m) > _BAND:
        return float(_FAR)
    cost = [[_FAR] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0
    for i in range(n + 1):
        row = cost[i]
        under = cost[i + 1] if i < n else None
        for j in range(max(0, i - _BAND), min(m, i + _BAND) + 1):
            c = row[j]
            if c >= _FAR:
                continue
            if under is not None:
                if c + 4 < under[j]:
                    under[j] = c + 4
                if j < m:
                    same = meant[i] == seen[j]
                    d = c if same else c + 4
                    if d < under[j + 1]:
                        under[j + 1] = d
                    for a, b in _TABLE.get((meant[i], seen[j]), ()):
                        if c + 1 < cost[min(i + len(a), n)][min(j + len(b), m)] and meant.startswith(a, i) and seen.startswith(b, j):
                            cost[i + len(a)][j + len(b)] = c + 1
            if j < m and c + 4 < row[j + 1]:
                row[j + 1] = c + 4
    return float(cost[n][m])


class Letters:
    """Letter-trigram statistics of word types; a word's score is its mean and its worst log-probability."""

    def __init__(self, three: dict[str, int]):
        self.three = Counter(three)
        self.two: Counter[str] = Counter()
        for t, n in three.items():
            self.two[t[:2]] += n

    @classmethod
    def of(cls, words: DataFrame) -> Letters:
        """The trigrams of all words(token), counted where the words are."""
        w = F.concat(F.lit("^^"), F.lower("token"), F.lit("$"))
        each = words.select(w.alias("w")).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring(F.col("w"), i, F.lit(3)))).alias("three"))
        return cls({r["three"]: r["n"] for r in each.groupBy("three").agg(F.count("*").alias("n")).collect()})

    def worst(self, word: str) -> float:
        s = f"^^{word.lower()}$"
        return min(math.log((self.three[s[i : i + 3]] + 0.1) / (self.two[s[i : i + 2]] + 4.0)) for i in range(len(s) - 2))


_PAIR = ["seen_docs", "meant_docs", "seen_n", "meant_n", "cost", "length", "seen_worst", "meant_worst", "same_doc"]


def _word_features(token: pd.Series, meant: pd.Series, letters: Letters) -> pd.DataFrame:
    """What a pair of words is like, wherever it stands."""
    return pd.DataFrame({
        "cost": [confusion_cost(a, b) for a, b in zip(token, meant, strict=True)],
        "seen_worst": [letters.worst(t) for t in token], "meant_worst": [letters.worst(t) for t in meant],
    }, dtype=float)


def _pair_features(p: pd.DataFrame) -> np.ndarray:
    out = np.zeros((len(p), len(_PAIR)))
    for i, c in enumerate(("seen_docs", "meant_docs", "seen_n", "meant_n")):
        out[:, i] = np.log1p(p[c].to_numpy(float))
    for i, c in enumerate(_PAIR[4:], 4):
        out[:, i] = p[c].to_numpy(float)
    return out


def misread(word: str, rng: np.random.Generator, table: tuple | list = CONFUSIONS) -> str | None:
    """The word with one confusion of the table, as a scanner might give it."""
    fits = [(i, a, b) for a, b in table for i in range(len(word)) if word.startswith(a, i)]
    if not fits:
        return None
    i, a, b = fits[rng.integers(len(fits))]
    return word[:i] + b + word[i + len(a) :]


def _drawn(word: str, seed: int) -> np.random.Generator:
    """Chance that depends on the word alone, wherever it is drawn."""
    return np.random.default_rng([seed, zlib.crc32(word.encode())])


def _misread_once_or_twice(word: str, rng: np.random.Generator, table: tuple | list, twice: float) -> str | None:
    s = misread(word, rng, table)
    return (misread(s, rng, table) or s) if s and rng.random() < twice else s


def _without_misreadings(words: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Words with their counts, most common first, without those that misread one at least eight times as common."""
    kept: list[tuple[str, int]] = []
    by_gram: dict[str, list[int]] = {}
    for w, f in sorted(words, key=lambda x: (-x[1], x[0])):
        near = Counter(k for g in _grams(w.lower(), 3) for i in (-1, 0, 1) for k in by_gram.get(f"{g[:3]}{int(g[3:]) + i}", ()))
        if any(kept[k][1] >= 8 * f and abs(len(kept[k][0]) - len(w)) <= 2 and confusion_cost(w, kept[k][0]) <= 2 for k, n in near.items() if n >= 2):
            continue
        for g in _grams(w.lower(), 3):
            by_gram.setdefault(g, []).append(len(kept))
        kept.append((w, f))
    return kept


_ASKED = ["token", "meant", "seen_docs", "meant_docs", "seen_n", "meant_n", "same_doc"]
_ASKED_KINDS = "token string, meant string, seen_docs long, meant_docs long, seen_n long, meant_n long, same_doc double"


def _misread_words(batches):
    """Rows of words(token, docs, n, common) that were misread by the table, a common word up to three times."""
    for p in batches:
        rows = []
        for w, f, n, common in zip(p["token"], p["docs"], p["n"], p["common"], strict=True):
            rng = _drawn(w, 7)
            for again in range(3 if common else 1):
                # a page that always confuses some letters does so twice in a word
                s = _misread_once_or_twice(w, rng, CONFUSIONS, float(again == 2) if common else 0.2)
                if s and common:
                    rows.append((s, w, 1 + int(rng.random() ** 3 * f / 20), f, 1 + int(rng.integers(0, 2)), int(rng.integers(0, 3)), 0.0, common))
                elif s:
                    local = rng.random() < 0.7
                    rows.append((s, w, 1, f, 1, max(2, n) if local else 0, float(local), common))
        yield pd.DataFrame(rows, columns=[*_ASKED, "common"])


#: Words of one block, of which every pair is compared in one task.
_WORDS = 20_000


def _three_nearest(words: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """(id, near, shared, tie): for each of words(id, w) the three of others(id, w, tie) with the most positional trigrams in common."""
    others = others.sort_values(["tie", "id"], kind="stable")
    places: dict[tuple[str, int], list[int]] = {}
    for k, w in enumerate(others["w"]):
        for i in range(max(len(w) - 2, 1)):
            places.setdefault((w[i : i + 3], i), []).append(k)
    held = {g: np.array(at) for g, at in places.items()}
    ids, ties = others["id"].to_numpy(), others["tie"].to_numpy()
    own = {x: k for k, x in enumerate(ids)}
    rows, found, counts = [], [], []
    for no, (x, w) in enumerate(zip(words["id"], words["w"], strict=True)):
        hits = [held[g] for g in ((w[i : i + 3], i) for i in range(max(len(w) - 2, 1))) if g in held]
        if not hits:
            continue
        shared = np.bincount(np.concatenate(hits), minlength=1)
        if own.get(x, len(shared)) < len(shared):
            shared[own[x]] = 0
        level, left = int(shared.max()), 3
        while level > 0 and left > 0:
            at = np.flatnonzero(shared == level)[:left]
            rows.append(np.full(len(at), no))
            found.append(at)
            counts.append(np.full(len(at), level))
            left -= len(at)
            level -= 1
    if not rows:
        return pd.DataFrame({"id": [], "near": [], "shared": [], "tie": []}, dtype=np.int64)
    at = np.concatenate(found)
    return pd.DataFrame({"id": words["id"].to_numpy()[np.concatenate(rows)], "near": ids[at], "shared": np.concatenate(counts), "tie": ties[at]})


def _nearest(words: DataFrame, scratch: Scratch, size: int = _WORDS) -> DataFrame:
    """(id, near): for each of words(id, token) the three others that share the most positional q-grams with it.

    Every pair of words is compared, in blocks: what is written grows with the words times the number of blocks, and no pair
    is written that is not among the three best of its block.
    """
    blocks = max(1, math.ceil(words.count() / size))
    base = words.where("length(token) >= 2").select("id", F.concat(F.lit("^"), F.lower("token"), F.lit("$")).alias("w"), F.xxhash64("id").alias("tie"))
    base = scratch.stage(base.withColumn("b", F.pmod("tie", F.lit(blocks)).cast("int")), "lowered")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = base.select("id", "w", F.col("b").alias("i"), F.explode(every).alias("j")).repartition(blocks * blocks, "i", "j")
    right = base.select("id", "w", "tie", F.explode(every).alias("i"), F.col("b").alias("j")).repartition(blocks * blocks, "i", "j")
    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_three_nearest, "id long, near long, shared long, tie long")
    order = Window.partitionBy("id").orderBy(F.desc("shared"), "tie", "near")
    return met.withColumn("place", F.row_number().over(order)).where("place <= 3").select("id", "near")


def _rank_rows(pool: DataFrame, scratch: Scratch) -> DataFrame:
    """The training rows of pool(token, docs, n, common): its words misread by the table against themselves, and pairs of different ones."""
    made = pool.mapInPandas(_misread_words, _ASKED_KINDS + ", common boolean")
    made = merge_join(made, pool.select("token", "common"), ["token", "common"], "left_anti").select(*_ASKED, F.lit(1.0).alias("label"), F.lit(1).alias("times"))
    words = scratch.stage(pool.groupBy("token").agg(F.max("docs").alias("docs"), F.max("n").alias("n")).withColumn("id", F.xxhash64("token")), "known")
    pairs = merge_join(_nearest(words, scratch), words, "id").drop("id")
    pairs = merge_join(pairs, words.select(F.col("id").alias("near"), F.col("token").alias("meant"), F.col("docs").alias("meant_docs"), F.col("n").alias("meant_n")), "near")
    pairs = pairs.where("abs(length(token) - length(meant)) <= 2").withColumn("same_doc", F.explode(F.array(F.lit(0.0), F.lit(1.0))))
    right = pairs.select("token", "meant", F.col("docs").alias("seen_docs"), "meant_docs", F.greatest("n", F.lit(1)).alias("seen_n"), "meant_n", "same_doc", F.lit(0.0).alias("label"), F.lit(2).alias("times"))
    return made.unionByName(right)


def _rank_model(pool: DataFrame, letters: Letters) -> Boosted:
    """Known words and names misread by the table against themselves, and pairs of different known words."""
    sent = pool.sparkSession.sparkContext.broadcast(letters)

    def features(batches):
        for p in batches:
            p = pd.concat([p, _word_features(p["token"], p["meant"], sent.value)], axis=1)
            p["length"] = p["token"].str.len()
            less, more = np.minimum(p["seen_docs"], p["meant_docs"]), np.maximum(p["seen_docs"], p["meant_docs"])
            # of words that are near each other one may well be a misreading of the other
            p = p[(p["label"] == 1) | (p["cost"] < _FAR) & ~((p["cost"] <= 3) & (20 * less < more))]
            yield pd.DataFrame(_pair_features(p), columns=_PAIR).assign(label=p["label"].to_numpy(), times=p["times"].to_numpy())

    with Scratch() as scratch:
        kinds = ", ".join(f"{c} double" for c in [*_PAIR, "label"])
        rows = scratch.stage(_rank_rows(pool, scratch).mapInPandas(features, f"{kinds}, times int"), "ranked")
        return Boosted(rounds=80, depth=4).fit_rows(rows, _PAIR, "label", "times")


#: At least two letters, and nothing but letters, inner marks and the signs that stand for misread letters.
_WORDLIKE = r"^(?=[^\p{L}]*\p{L}[^\p{L}]*\p{L})(?![A-Z]{1,3}[-/]?[0-9])[\p{L}!|†@0-9][\p{L}'!|†@0-9-]*$"


#: Characters of the longest token that is compared with others; longer ones are no words.
LONGEST = 60


def _holes(words: DataFrame, name: str, seen: bool) -> DataFrame:
    """For words of 5 to 8 letters the keys of their two ends around a hole in the middle: (first letters, last letters, length
    of the misread word), by which words meet whose misreading leaves no q-gram whole."""
    w, n = F.lower(name), F.length(name)
    lengths = F.array(n) if seen else F.array(n - 1, n, n + 1)
    cut = lambda i, j: F.concat_ws("~", F.substring(w, 1, i), F.expr(f"right(lower({name}), {j})"))
    keyed = words.select(name, F.explode(lengths).alias("at"))
    some = F.when(F.col("at") >= 7, F.array(cut(3, 3))).otherwise(F.array(cut(2, 2), cut(1, 2), cut(2, 1)))
    return keyed.where("at between 5 and 8").select(name, "at", F.explode(some).alias("gram"))


def corrections(types: DataFrame) -> DataFrame:
    """(doc, token, meant, p) for misread words of types(doc, token, n) that look like words."""
    with Scratch() as scratch:
        return _corrections(types, scratch)


def _corrections(types: DataFrame, scratch: Scratch) -> DataFrame:
    spark = types.sparkSession
    words = types.where(F.col("token").rlike(_WORDLIKE) & (F.length("token") <= LONGEST))
    docs = types.select("doc").distinct().count()
    totals = scratch.stage(words.groupBy("token").agg(F.count("*").alias("docs"), F.max("n").alias("n")), "totals")
    types = scratch.stage(merge_join(words, totals.select("token", "docs"), "token"), "words")
    often = COMMON * docs
    rare = (F.col("docs") < max(6.0, RARE * docs)) & ((F.length("token") >= 4) | F.col("token").rlike(r"^[\p{Lu}l][\p{Lu}]+$"))
    seldom = totals.where(rare)
    common = totals.where(F.col("docs") >= max(3.0, often))

    def meet(left: DataFrame, right: DataFrame, q: int, least: int, on: list[str]) -> DataFrame:
        """Pairs that share at least `least` positional q-grams and differ in at most three letters."""
        a = _gram_rows(left, q, False)
        b = _gram_rows(right, q, not on).withColumnRenamed("token", "meant").withColumnRenamed("n", "meant_n")
        if on:  # the words of one document are few to a q-gram: places are compared and not spread
            met = merge_join(a, b.withColumnRenamed("at", "there"), ["gram", *on]).where("abs(at - there) <= 1")
        else:
            met = merge_join(a, b, ["gram", "at"])
        hit = met.where("token <> meant and abs(length(token) - length(meant)) <= 2")
        values = [F.first(c).alias(c) for c in ("n", "meant_n") if c in hit.columns]
        met = hit.groupBy(*on, "token", "meant").agg(F.count("*").alias("shared"), *values)
        return met.where(F.col("shared") >= F.when(F.length("token") <= 5, 1).otherwise(least)).where(F.levenshtein("token", "meant") <= 3).drop("shared")

    glob = meet(seldom.select("token"), common.select("token"), 3, 2, [])
    local_types = types.where(rare).select("doc", "token", "n")
    local = scratch.stage(meet(local_types, local_types.where("n >= 2"), 3, 3, ["doc"]), "local")
    shared = totals.where(F.col("docs") >= 2).where(F.col("docs") < max(3.0, often)).where("length(token) >= 5").select("token")
    alone = seldom.where(F.col("docs") <= max(3.0, often) / 2).where("length(token) >= 5").select("token")
    names = meet(alone.where("length(token) >= 7"), shared.where("length(token) >= 6"), 5, 1, [])
    holes = merge_join(_holes(alone, "token", True), _holes(shared.withColumnRenamed("token", "meant"), "meant", False), ["gram", "at"]).select("token", "meant").where(F.levenshtein("token", "meant") <= 3)

    # a pair of words is scored once, wherever it stands
    everywhere = glob.unionByName(names).unionByName(holes).where("token <> meant").distinct()
    pairs = everywhere.withColumn("wide", F.lit(True)).unionByName(local.select("token", "meant").distinct().withColumn("wide", F.lit(False))).groupBy("token", "meant").agg(F.max("wide").alias("wide"))
    pairs = merge_join(pairs, totals.select("token", F.col("docs").alias("seen_docs")), "token")
    pairs = scratch.stage(merge_join(pairs, totals.select(F.col("token").alias("meant"), F.col("docs").alias("meant_docs")), "meant"), "pairs")

    clean = common.where(F.col("token").rlike(r"^[\p{L}'-]+$"))
    # a document of the mean number of words brings at most 200 of them
    known = clean.where(F.col("docs") >= max(3, 0.005 * docs)).select("token", "docs").collect()
    good = _without_misreadings([tuple(r) for r in known])
    own = seldom.where((F.col("docs") < max(6.0, 0.03 * docs)) & F.col("token").rlike(r"^\p{Lu}\p{Ll}{5,}$") & (F.col("n") >= 3)).select("token", "docs", "n", F.lit(False).alias("common"))
    pool = scratch.stage(own.unionByName(spark.createDataFrame([(w, f, 0, True) for w, f in good], "token string, docs long, n long, common boolean")), "pool")
    letters = Letters.of(pool)
    sent = spark.sparkContext.broadcast((_rank_model(pool, letters), letters))

    @F.pandas_udf("cost double, seen_worst double, meant_worst double")
    def alike(token: pd.Series, meant: pd.Series) -> pd.DataFrame:
        return _word_features(token, meant, sent.value[1])

    @F.pandas_udf(DoubleType())
    def rank(*cols: pd.Series) -> pd.Series:
        return pd.Series(sent.value[0].predict(_pair_features(pd.concat(cols, axis=1, keys=_PAIR))))

    scored = scratch.stage(pairs.withColumn("f", alike("token", "meant")).select("token", "meant", "wide", "seen_docs", "meant_docs", "f.*").where(F.col("cost") <= MOST_CONFUSIONS), "scored")
    placed = merge_join(scored.where("wide and meant_docs >= 2 * seen_docs").select("token", "meant"), types.select("doc", "token", "n"), "token")
    placed = merge_join(placed, types.select("doc", F.col("token").alias("meant"), F.col("n").alias("meant_n")), ["doc", "meant"], "left").na.fill(0, ["meant_n"])
    every = placed.select("doc", "token", "meant", "n", "meant_n").unionByName(local.select("doc", "token", "meant", "n", "meant_n"))
    every = every.groupBy("doc", "token", "meant").agg(F.max("n").alias("seen_n"), F.max("meant_n").alias("meant_n"))
    every = merge_join(every, scored.drop("wide"), ["token", "meant"]).where((F.col("meant_docs") >= 2 * F.col("seen_docs")) | (F.col("meant_n") > F.col("seen_n")))
    every = every.withColumn("same_doc", (F.col("meant_n") > 0).cast("double")).withColumn("length", F.length("token"))
    best = every.withColumn("p", rank(*_PAIR)).where("p >= 0.5").groupBy("doc", "token").agg(F.max(F.struct(F.round("p", 1).alias("p"), "meant_docs", "meant_n", "meant")).alias("b"))
    return Stage(best.select("doc", "token", F.col("b.meant").alias("meant"), F.col("b.p").alias("p")), "fixed").df


def page_noise(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, noise): running, hyphenation or misread; a line may have the last two."""
    with Scratch() as scratch:
        return Stage(_parts(pages, scratch)["noise"], "noise").df


def _parts(pages: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    lines = scratch.stage(page_lines(pages), "lines")
    edge = scratch.stage(furniture(lines, scratch), "furniture")
    with Scratch() as brief:
        run = scratch.stage(running_lines(lines, edge, brief), "running")
    cut = scratch.stage(broken_words(run, scratch), "broken")
    tokens = scratch.stage(tokens_of(run, cut), "tokens")
    types = scratch.stage(tokens.groupBy("doc", "token").agg(F.count("*").alias("n")), "types")
    fixed = corrections(types)
    read = sign_readings(scratch.stage(types.groupBy("token").agg(F.count("*").alias("docs")), "tokens"))
    hit = merge_join(tokens, fixed.select("doc", "token", "meant"), ["doc", "token"])
    hit = hit.unionByName(merge_join(tokens.where(F.col("token").rlike("[0-9!|†@ﬀ-ﬆ]")), read, "token").select(hit.columns))
    # of a word over a line end each part is compared with the part of what was meant
    a = hit.where("left is null or not startswith(meant, left)").select("page_id", "line_no")
    b = hit.where("left is not null and not endswith(meant, substr(token, length(left) + 1))").select(F.col("next_page").alias("page_id"), F.col("next_line").alias("line_no"))
    noise = (
        edge.select("page_id", "line_no", F.lit("running").alias("noise"))
        .unionByName(cut.where("broken").select("page_id", "line_no", F.lit("hyphenation").alias("noise")))
        .unionByName(a.unionByName(b).distinct().select("page_id", "line_no", F.lit("misread").alias("noise")))
    )
    return {"lines": lines, "edge": edge, "run": run, "cut": cut, "tokens": tokens, "fixed": fixed, "read": read, "noise": noise}


# ---------------------------------------------------------------- repaired text


def repaired_paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_name, paragraph, text): continuous text without furniture, broken words joined, misread words replaced.

    A paragraph begins after a blank line, and at the top of a page where the text before it ends in a short line with a
    full stop. Paragraphs are numbered by running sums over blocks of pages, then over the pages of a block.
    """
    with Scratch() as scratch:
        return Stage(_paragraphs(_parts(pages, scratch), scratch), "paragraphs").df


def _paragraphs(part: dict[str, DataFrame], scratch: Scratch) -> DataFrame:
    fixed = part["fixed"].select("doc", "token", "meant")
    # one row per line with its words replaced; a word over a line end stands in the line it starts in
    placed = tokens_of(part["run"], part["cut"], place=True)
    words = merge_join(merge_join(placed, fixed, ["doc", "token"], "left"), part["read"].withColumnRenamed("meant", "read"), "token", "left").withColumn("best", F.coalesce("meant", "read", "token"))
    words = words.withColumn("word", F.concat("before", "best", "behind"))
    lines = words.groupBy("page_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    base = merge_join(part["lines"].select("page_id", "doc", "page", "line_no", "gap_before", "line", "widest"), part["edge"], ["page_id", "line_no"], "left_anti")
    w = Window.partitionBy("page_id").orderBy("line_no")
    base = merge_join(base.withColumn("rank", F.row_number().over(w)), lines, ["page_id", "line_no"], "left")
    last = base.groupBy("doc", "page").agg(F.max_by(F.struct("line", "widest"), "line_no").alias("l"))
    closed = last.select("doc", (F.col("page") + 1).alias("page"), (F.col("l.line").rlike(r"[.:?!]$") & (F.length("l.line") < 0.85 * F.col("l.widest"))).alias("closed"))
    base = merge_join(base, closed, ["doc", "page"], "left")
    fresh = F.when(F.col("rank") == 1, F.coalesce("closed", F.lit(True))).otherwise(F.col("gap_before")).cast("int")
    base = scratch.stage(base.select("page_id", "doc", "page", "line_no", "text", fresh.alias("fresh")), "fresh")
    block = F.floor(F.coalesce("page", F.lit(0)) / 1000)
    per_page = base.groupBy("doc", "page", "page_id").agg(F.sum("fresh").alias("n")).withColumn("block", block)
    per_block = per_page.groupBy("doc", "block").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_block.select("doc", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("doc", "block").orderBy("page", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    page_start = merge_join(per_page.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))), shift, ["doc", "block"]).select("page_id", (F.col("inner") + F.col("shift")).alias("start"))
    run_no = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = merge_join(base.withColumn("inner", F.sum("fresh").over(run_no)), page_start, "page_id").withColumn("paragraph", F.greatest(F.col("start") + F.col("inner"), F.lit(1)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "page_id", "line_no", "text"))), lambda x: x["text"]), " ")
    return numbered.where("text <> ''").groupBy(F.col("doc").alias("doc_name"), "paragraph").agg(text.alias("text"))
