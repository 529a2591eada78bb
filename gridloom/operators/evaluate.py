"""Evaluation: clusterings against gold, alias recognition, answers, and coverage of contexts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gridloom.functions.text import approx_equal, is_abstention, normalize_name, parse_numbers, set_f1, yes_no
from gridloom.session import Stage


def labels(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """(item, label): the first cluster of an item counts, items without one stand alone."""
    one = clusters.groupBy(F.col("node_id").alias("item")).agg(F.min("cluster_id").alias("cluster"))
    return items.select("item").distinct().join(one, "item", "left").select("item", F.coalesce(F.concat(F.lit("c:"), F.col("cluster").cast("string")), F.concat(F.lit("i:"), F.col("item"))).alias("label"))


def _pairs(df: DataFrame, by: list[str], name: str) -> DataFrame:
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).cast("bigint").alias(name))


def pairwise_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(predicted_pairs, gold_pairs, shared_pairs, precision, recall, f1) over items in gold, from group sizes; no pair is formed.

    precision is null without predicted pairs, recall without gold pairs; f1 is 0 when either is 0 or null.
    """
    both = gold.select("item", F.col("label").alias("g")).join(predicted.select("item", F.col("label").alias("p")), "item")
    t = _pairs(both, ["p"], "predicted_pairs").join(_pairs(both, ["g"], "gold_pairs")).join(_pairs(both, ["p", "g"], "shared_pairs"))
    p = F.col("shared_pairs") / F.nullif(F.col("predicted_pairs"), F.lit(0))
    r = F.col("shared_pairs") / F.nullif(F.col("gold_pairs"), F.lit(0))
    f1 = F.when((F.coalesce(p, F.lit(0.0)) > 0) & (F.coalesce(r, F.lit(0.0)) > 0), 2 * p * r / (p + r)).otherwise(0.0)
    return t.select("predicted_pairs", "gold_pairs", "shared_pairs", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def purity(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(purity, inverse_purity): shares of items in the greatest overlap of their cluster, seen from either side."""
    both = gold.select("item", F.col("label").alias("g")).join(predicted.select("item", F.col("label").alias("p")), "item")
    cell = both.groupBy("p", "g").agg(F.count("*").alias("n"))
    side = lambda c, name: cell.groupBy(c).agg(F.max("n").alias("m")).agg(F.sum("m").alias(name))
    t = both.agg(F.count("*").alias("n")).join(side("p", "a")).join(side("g", "b"))
    return t.select(F.round(F.col("a") / F.col("n"), 6).alias("purity"), F.round(F.col("b") / F.col("n"), 6).alias("inverse_purity"))


def alias_index(aliases: DataFrame, ambiguous: DataFrame | None = None) -> DataFrame:
    """(alias, entity): normalised aliases with exactly one owner that are not declared ambiguous."""
    rows = aliases.select(normalize_name(F.col("alias")).alias("alias"), "entity").where("alias <> ''")
    one = rows.groupBy("alias").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).where("entity = other").drop("other")
    if ambiguous is not None:
        one = one.join(ambiguous.select(normalize_name(F.col("alias")).alias("alias")).distinct(), "alias", "left_anti")
    return one


def _window_hashes(tokens: list[str], longest: int):
    """For n from 1 to longest the hashes of the windows of n tokens, by the place of their first one."""
    each = pd.util.hash_array(np.array(tokens, dtype=object))
    total, by = np.zeros(len(each), np.uint64), 1
    for n in range(1, longest + 1):
        by = by * int(_ODD) % (1 << 64)
        total = total[: len(each) - n + 1] + each[n - 1 :] * np.uint64(by)
        yield n, total


_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bits per alias of the filter, at most 2 ** 28 in all (32 MB); bits of one row when it is gathered.
_BITS, _MOST, _ROW = 64, 28, 65_536


def _probes(hashes: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - power)
    return tuple(((hashes ^ hashes >> np.uint64(31)) * f >> shift).astype(np.int64) for f in (_ODD, _OTHER))


def _alias_filter(index: DataFrame) -> tuple[np.ndarray, int]:
    """Bits that every alias sets and few other word windows find set, and the power of two of their number."""
    power = int(min(_MOST, max(16, np.ceil(np.log2(_BITS * max(1, index.count()))))))

    def places(batches):
        for p in batches:
            split = [alias.split(" ") for alias in p["alias"]]
            sizes = np.array([len(t) for t in split], np.int64)
            start, at = np.cumsum(sizes) - sizes, [np.zeros(0, np.int64)]
            for n, hashes in _window_hashes([t for ts in split for t in ts], int(sizes.max(initial=0))):
                at += _probes(hashes[start[sizes == n]], power)
            at = np.concatenate(at)
            yield pd.DataFrame({"row": at // _ROW, "bit": at % _ROW}).drop_duplicates()

    def packed(p: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(_ROW, bool)
        bits[p["bit"].to_numpy()] = True
        return pd.DataFrame({"row": [p["row"].iat[0]], "bits": [np.packbits(bits).tobytes()]})

    held = np.zeros(1 << power, bool)
    for r in index.select("alias").mapInPandas(places, "row long, bit long").groupBy("row").applyInPandas(packed, "row long, bits binary").collect():
        held[r["row"] * _ROW : (r["row"] + 1) * _ROW] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return np.packbits(held), power


def recognise(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(id, entities): entities named in each text, left to right, longest alias first, whole words, each once.

    Word windows as long as some alias is meet the index in an equality join; only those that pass a filter of bits set by all
    aliases are written for it. The greedy choice without overlap is then made per text over its hits.
    """
    index = Stage(index, "aliases").df
    lengths = {r[0] for r in index.select(F.size(F.split("alias", " ")).alias("n")).distinct().collect()}  # words of a name
    sent = texts.sparkSession.sparkContext.broadcast(_alias_filter(index))
    longest = max(lengths, default=0)

    def windows(batches):
        bits, power = sent.value
        for p in batches:
            # texts of about a million letters at once
            for _, part in p.groupby(p["text"].str.len().cumsum() // 1_000_000, sort=False):
                split = [t.split() for t in part["text"]]
                sizes, tokens = np.array([len(t) for t in split], np.int64), [t for ts in split for t in ts]
                if not tokens:
                    continue
                text, start = np.repeat(np.arange(len(split)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
                for n, hashes in _window_hashes(tokens, min(longest, int(sizes.max()))):
                    if n not in lengths:
                        continue
                    a, b = _probes(hashes, power)
                    at = np.flatnonzero((bits[a >> 3] >> (7 - (a & 7)) & 1) & (bits[b >> 3] >> (7 - (b & 7)) & 1) & (text[: len(a)] == text[n - 1 :]))
                    if len(at):
                        yield pd.DataFrame({"id": part["id"].to_numpy()[text[at]], "at": at - start[at] + 1, "n": n, "alias": [" ".join(tokens[k : k + n]) for k in at]})

    named = texts.where("id is not null").select("id", normalize_name(F.col("text")).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    found = named.mapInPandas(windows, f"id {kind}, at int, n int, alias string")
    hits = found.join(index, "alias").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("m"), "entity"))).alias("hits"))

    @F.pandas_udf(ArrayType(StringType()))
    def greedy(column: pd.Series) -> pd.Series:
        def one(found) -> list[str]:
            out, free = [], 0
            for h in found:
                if h["at"] >= free:
                    free = h["at"] - h["m"]
                    if h["entity"] not in out:
                        out.append(h["entity"])
            return out

        return column.map(one)

    return texts.select("id").join(hits.select("id", greedy("hits").alias("entities")), "id", "left").select("id", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def align(names: DataFrame, index: DataFrame) -> DataFrame:
    """(id, entity): by exact alias, else by the single entity recognised in the text."""
    exact = names.select("id", normalize_name(F.col("text")).alias("alias")).join(index, "alias").select("id", F.col("entity").alias("exact"))
    seen = recognise(names, index).where(F.size("entities") == 1).select("id", F.element_at("entities", 1).alias("single"))
    return names.select("id").join(exact, "id", "left").join(seen, "id", "left").select("id", F.coalesce("exact", "single").alias("entity"))


def answer_score(kind: Column, answer: Column, gold: Column, found: Column, gold_entities: Column) -> Column:
    """Score of an answer by its kind; abstentions score 0.

    entity: the entity is among those found; entity_any: any of the gold ones; entity_list: F1 of the sets; number: any number
    equals the gold one; yes_no: both read alike; string: the normalised gold stands in the answer.
    """
    hit = F.arrays_overlap(found, gold_entities)
    number = F.exists(parse_numbers(answer), lambda x: approx_equal(x, F.element_at(parse_numbers(gold), 1)))
    text = F.contains(F.concat(F.lit(" "), normalize_name(answer), F.lit(" ")), F.concat(F.lit(" "), normalize_name(gold), F.lit(" ")))
    s = (
        F.when(kind.isin("entity", "entity_any"), hit.cast("double"))
        .when(kind == "entity_list", set_f1(found, gold_entities))
        .when(kind == "number", number.cast("double"))
        .when(kind == "yes_no", (yes_no(answer) == yes_no(gold)).cast("double"))
        .otherwise(text.cast("double"))
    )
    return F.when(is_abstention(answer), 0.0).otherwise(F.coalesce(s, F.lit(0.0)))


def context_coverage(contexts: DataFrame, needed: DataFrame) -> DataFrame:
    """(id, coverage, complete): share of the entities a question needs that its context names.

    contexts(id, entity), needed(id, entity).
    """
    hit = needed.distinct().join(contexts.select("id", "entity", F.lit(1).alias("hit")).distinct(), ["id", "entity"], "left")
    return hit.groupBy("id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("coverage"), (F.count("hit") == F.count("*")).alias("complete"))


def path_hit(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, hit): whether some alternative has every step joined in the subgraph, in either direction.

    edges(id, a, b), paths(id, alternative, a, b).
    """
    e = edges.select("id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("there", F.lit(1))
    p = paths.select("id", "alternative", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    alt = p.join(e, ["id", "a", "b"], "left").groupBy("id", "alternative").agg((F.count("there") == F.count("*")).alias("hit"))
    return alt.groupBy("id").agg(F.max("hit").alias("hit"))


def complete_questions(scores: DataFrame) -> DataFrame:
    """Rows of the questions that every system answered."""
    n = scores.agg(F.countDistinct("system").alias("systems"))
    full = scores.groupBy("id").agg(F.countDistinct("system").alias("k")).join(n).where("k = systems").select("id")
    return scores.join(full, "id", "left_semi")


def means(scores: DataFrame, by: list[list[str]]) -> DataFrame:
    """(group columns..., n, mean_score, median_score) over several groupings at once."""
    out = None
    every = sorted({c for g in by for c in g})
    for g in by:
        part = scores.groupBy(*g).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.median("score"), 4).alias("median_score"))
        part = part.select(*[(F.col(c) if c in g else F.lit(None)).cast("string").alias(c) for c in every], "n", "mean_score", "median_score")
        out = part if out is None else out.unionByName(part)
    return out


def question_order(questions: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(id, priority): round robin over types in their given or alphabetical order, in order of id inside a type."""
    w = Window.partitionBy("type").orderBy("id")
    if types is None:
        order = questions.select("type").distinct().withColumn("at", F.row_number().over(Window.orderBy("type")) - 1)  # one row per type
        questions, index = questions.join(order, "type"), F.col("at")
    else:
        index = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("type")) - 1
    return questions.select("id", "type", ((F.row_number().over(w) - 1) * 10 + index).cast("bigint").alias("priority"))


def smallest_cover(requirements: DataFrame, documents: list[str] | None = None) -> list[str] | None:
    """The smallest choice of documents (of those given) that meets every requirement(id, document) of one question; of equals the first in order.

    A question's requirements are few; sets that contain another are met with it and are left out before the search, which branches
    on the documents of the smallest set still open.
    """
    sets = sorted({frozenset(x for x in r[0] if documents is None or x in documents) for r in requirements.groupBy("id").agg(F.collect_set("document")).select("collect_set(document)").distinct().collect()}, key=lambda x: (len(x), sorted(x)))
    if sets and not sets[0]:
        return None
    needed = [x for i, x in enumerate(sets) if not any(y < x for y in sets[:i])]

    def choices(open_: list[frozenset], left: int):
        if not open_:
            yield ()
        elif left:
            for pick in sorted(min(open_, key=len)):
                for rest in choices([x for x in open_ if pick not in x], left - 1):
                    yield (pick, *rest)

    for k in range(len(needed) + 1):
        found = sorted(tuple(sorted(c)) for c in choices(needed, k))
        if found:
            return list(found[0])
    return None


def render_context(edges: DataFrame, citations: DataFrame) -> DataFrame:
    """(kind, line): a subgraph and its sources as text lines."""
    e = edges.select(F.lit("relationship").alias("kind"), F.concat_ws(" ", "from_name", F.concat(F.lit("-["), "relationship_type", F.lit("]->")), "to_name").alias("line"))
    c = citations.select(F.lit("source").alias("kind"), F.concat_ws(" ", "document_name", F.concat(F.lit("(pages "), F.array_join("pages", ", "), F.lit(")"))).alias("line"))
    return e.unionByName(c).distinct()


def relation_facts(edges: DataFrame) -> DataFrame:
    """(a, b, relationship_type, documents): one fact per unordered pair and type with its documents, sorted."""
    pair = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relationship_type", "source_doc")
    return pair.groupBy("a", "b", "relationship_type").agg(F.array_sort(F.collect_set("source_doc")).alias("documents"))


def fact_support(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, documents): documents that state any relationship between the two of each pair, in either direction."""
    wanted = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    facts = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "source_doc").distinct()
    return wanted.join(facts, ["a", "b"], "left").groupBy("a", "b").agg(F.array_sort(F.collect_set("source_doc")).alias("documents"))
