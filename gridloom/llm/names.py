"""Variant spellings of names typed by people.

Every name is rewritten to canonical forms: honorifics dropped, legal forms and abbreviations spelled out, nicknames
and initials kept as alternatives, tokens freed of their order, letters respelled by sound, and the rare part of the
name (its core) with each single letter left out, so that one wrong, missing, added or swapped letter still meets
in a form. Surfaces and entities are exploded to forms and joined on equality; a pair scores by the rarity of the
rewriting it shares and by how the remaining words agree. Every recorded name of an
entity is rewritten and scored by its own words and legal form. A surface is linked to the entity with the best score
where that is good enough and clearly better than the next. The rarity of a form is the share of the entities that do not reach it, on a logarithmic
scale: a form of one entity counts in full, one that all share not at all. Forms with a letter left out rewrite misspellings;
they are reached by all spellings within a letter and are rarer the fewer these are.

Which words are generic (given names, trades) is counted over all entity names: those in at least GENERIC_SHARE of
the entities, so at most the words of a name / GENERIC_SHARE, which is what makes the list fit for broadcast. A name of generic words only
(a rare word that many entities share is one) meets others of its kind in the form of the empty core.

No form is left out for being common. Entities that agree in all that the score looks at (words, legal form, kind) are
one shape, of which two entities stand for all: that keeps the best and the next score. A form of more than COMMON
shapes is joined together with a word of the name, exactly: a surface of n words that may leave `u` of them without a
counterpart and still reach LEAST_SCORE shares one of its u + 1 rarest words (in full or by initial) with the entity, or
the entity has no words; for a surface without words only the number of the entity's words counts.

Defined results: null and blank surfaces and ties are not linked; repeated rows are linked each; names are compared
whole, however long; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridloom.session import Scratch, Stage, merge_join, skew_join

GENERIC_SHARE, GENERIC_LEAST, COMMON = 0.002, 4, 200
LEAST_SCORE, MARGIN = 3.0, 0.25

#: Words before names, legal forms, irregular abbreviations and nicknames.
HONORIFICS = frozenset("mr mrs ms miss dr shri smt sri kumari messrs the prof and of".split())
LEGAL = {"limited": "ltd", "ltd": "ltd", "lmtd": "ltd", "private": "pvt", "pvt": "pvt", "llp": "llp",
         "liability": "llp", "partnership": "llp", "co": "co", "company": "co"}
IRREGULAR = {"buro": "bureau", "coc": "chamber", "fdn": "foundation", "fndn": "foundation"}
NICKNAMES = {
    "robert": "bob rob bobby", "william": "bill will billy", "elizabeth": "liz betty beth lizzie eliza", "margaret": "peggy maggie meg",
    "edward": "ted ned ed eddie", "christopher": "kit chris topher", "katherine": "kate kathy katie", "stephen": "steve steven",
    "tobias": "toby", "rebecca": "becky", "michael": "mike mick", "alexander": "sandy alex alec", "oliver": "ollie noll",
    "eleanor": "nell ellie nora", "leonard": "len lenny", "dorothea": "dolly dot", "nicholas": "nick", "francis": "frank fran",
    "veronica": "ronnie", "harriet": "hattie", "gabriel": "gabe", "theodora": "dora thea", "charlotte": "lottie charlie",
    "ottilie": "tilly", "wilhelmina": "mina minnie", "victoria": "vicky", "zachary": "zack zach", "rajendra": "raju raj",
    "lakshmi": "laxmi", "bernard": "bernie", "jonathan": "jon johnny", "devendra": "dev", "nathaniel": "nat nate",
    "siddharth": "sid", "frederick": "fred freddie", "benjamin": "ben benny", "daniel": "dan danny", "samuel": "sam sammy",
    "timothy": "tim timmy", "winston": "win winnie", "jaideep": "jai", "yashwant": "yash", "leopold": "leo", "philippa": "pip pippa",
    "aditya": "adi", "madhavi": "madhu", "james": "jim jimmy jamie", "john": "jack johnny", "richard": "dick rick", "thomas": "tom tommy",
    "albert": "al bert", "alfred": "alf fred", "arthur": "art", "barbara": "barb babs", "beatrice": "bea trixie", "caroline": "carrie", "catherine": "cathy cat",
    "charles": "chas chuck charlie", "cynthia": "cindy", "david": "dave davy", "deborah": "deb debbie", "donald": "don donnie", "dorothy": "dot dolly", "emily": "em emmy",
    "eugene": "gene", "florence": "flo florrie", "gerald": "gerry jerry", "gregory": "greg", "harold": "hal harry", "henry": "hank harry", "isabella": "bella izzy",
    "jacob": "jake", "jennifer": "jen jenny", "jessica": "jess jessie", "josephine": "jo josie", "judith": "judy", "kenneth": "ken kenny", "louis": "lou",
    "martin": "marty", "matthew": "matt", "mildred": "millie", "pamela": "pam", "peter": "pete", "philip": "phil pip", "raymond": "ray", "ronald": "ron ronnie",
    "sarah": "sally sadie", "simon": "si", "stanley": "stan", "teresa": "terry tess", "valerie": "val", "vincent": "vince vinny", "walter": "walt wally",
    "mohammed": "mo", "subramaniam": "subbu", "venkatesh": "venky", "krishnan": "kris",
    "andrew": "andy drew", "anthony": "tony", "joseph": "joe", "patrick": "paddy pat", "lawrence": "larry", "susan": "sue susie",
}
_SOUNDS = (("ee", "i"), ("oo", "u"), ("ph", "f"), ("th", "t"), ("sh", "s"), ("kh", "k"), ("ck", "k"), ("w", "v"), ("y", "i"), ("z", "j"), ("c", "k"), ("q", "k"), ("x", "ks"))


def by_sound(word: str) -> str:
    for a, b in _SOUNDS:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def shortened(word: str) -> set[str]:
    """The word and the word with each single letter left out."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


#: Long legal forms and those with one letter left out, so that a misspelled one is known.
LEGAL_NEAR = {x: kind for form, kind in LEGAL.items() if len(form) >= 7 for x in shortened(form)}


def tokens(name: str) -> list[str]:
    s = unicodedata.normalize("NFKC", name).lower()
    s = re.sub(r"\bm\s*/\s*s\b\.?", " ", s).replace("&", " and ")
    s = re.sub(r"\(\s*p\s*\)", " pvt ", s)
    s = re.sub(r"\bl\.\s*l\.\s*p\b\.?", " llp ", s)
    s = re.sub(r"\bp\b\.?\s*(?=(?:ltd|limited|lmtd)\b)", " pvt ", s)
    return re.findall(r"[^\W_]+", s)


def _is_subsequence(short: str, word: str) -> bool:
    rest = iter(word)
    return all(ch in rest for ch in short)


class Rules:
    """The rewriting rules over one list of generic words and one of nicknames (full name -> its nicknames, by spaces)."""

    def __init__(self, generic: list[str], nicknames: dict[str, str] | None = None):
        self.generic = frozenset(generic)
        self.sound = {by_sound(g): g for g in sorted(generic)}
        self.near: dict[str, set[str]] = defaultdict(set)
        for g in generic:
            for x in shortened(g):
                self.near[x].add(g)
        self.nick: dict[str, set[str]] = defaultdict(set)
        for full, short in (NICKNAMES if nicknames is None else nicknames).items():
            if full in self.generic:
                for n in short.split():
                    self.nick[n].add(full)
        self.long = sorted((g for g in generic if len(g) >= 4), key=lambda g: (-len(g), g))
        self.meant = functools.lru_cache(200_000)(self._meant)

    def _meant(self, t: str) -> tuple[str, ...]:
        """The generic words that a token may stand for: irregular, nickname, sound, one letter off, abbreviation."""
        if t in IRREGULAR and IRREGULAR[t] in self.generic:
            return (IRREGULAR[t],)
        if t in self.nick:
            return tuple(sorted(self.nick[t]))
        if len(t) > 3 and by_sound(t) in self.sound:
            return (self.sound[by_sound(t)],)
        off = sorted({g for x in shortened(t) for g in self.near.get(x, ())}) if len(t) >= 3 else []
        if off and len(t) >= 4:
            return tuple(off)
        body = t[:-1] if t.endswith("s") and len(t) > 3 else t
        if 3 <= len(t) <= 7:
            found = [g for g in self.generic if g.startswith((body, t))] or [
                g for g in self.generic if g[0] == t[0] and len(g) >= len(body) + 2 and not re.search("[aeiou]", body[1:-1]) and _is_subsequence(body, g)
            ]
            if found:
                return tuple(sorted(found))
        if len(t) >= 6:
            found = [g for g in self.generic if g[:6] == t[:6] and len(t) <= len(g) + 2]
            if found:
                return tuple(sorted(found))
        return tuple(off)

    def unglue(self, t: str) -> tuple[list[str], str]:
        """A token with generic words written onto its ends, as those words and the rest."""
        words: list[str] = []
        again = True
        while again and len(t) >= 8:
            again = False
            for g in self.long:
                if len(t) - len(g) >= 4 and (t.endswith(g) or t.startswith(g)):
                    t = t[: -len(g)] if t.endswith(g) else t[len(g) :]
                    words.append(g)
                    again = True
                    break
        return words, t

    def parse(self, name: str) -> dict:
        """core: the rare part as one word; words: generic words, alternatives joined by |, initials with a dot."""
        toks = tokens(name)
        words, core, legal, loose, wide = [], [], set(), [], []
        for t in toks:
            if t in HONORIFICS:
                continue
            if t in LEGAL:
                legal.add(LEGAL[t])
            elif t not in self.generic and len(t) >= 6 and (near := shortened(t) & LEGAL_NEAR.keys()):
                legal |= {LEGAL_NEAR[x] for x in near}
            elif t in self.generic:
                words.append(t)
            elif len(t) == 1:
                words.append(t + ".")
            elif meant := self.meant(t):
                words.append("|".join(meant))
                loose.append("|".join(meant))
                wide.append(t)
            else:
                more, t = self.unglue(t)
                words += more
                core.append(t)
                wide.append(t)
        kind = next((k for k in ("llp", "pvt", "ltd") if k in legal), "")
        out = {"core": "".join(core), "words": words, "legal": kind, "whole": " ".join(sorted(toks)), "wide_core": "", "wide_words": []}
        if loose:  # the loose words may as well be pieces of the rare part
            left = list(words)
            for w in loose:
                left.remove(w)
            out |= {"wide_core": "".join(wide), "wide_words": left}
        return out


def forms(core: str, words: list[str]) -> set[str]:
    """The forms of a core, each led by its level: 1 as written, 2 by sound, 3 with a letter left out."""
    if not core:
        return set()
    out = {"1" + core, "2" + by_sound(core)}
    if len(core) >= 5:
        out |= {"3" + x for x in shortened(core)}
    for w in words:
        for alt in w.split("|"):
            out |= {f"{f} {alt[0]}" for f in list(out) if " " not in f}
            if not alt.endswith("."):
                out |= {f"1{core} {alt}"}
    return out


def agreement(words: list[str], legal: str, other: list[str], other_legal: str, organisation: bool) -> float:
    """How the words beside the core agree; a word of the surface without a counterpart weighs against the pair."""
    score, rest = 0.0, list(other)
    for w in words:
        best, hit = 0.0, -1
        for j, y in enumerate(rest):
            if w == y:
                s = 3.0
            elif w.endswith(".") or y.endswith("."):
                s = 1.5 if any(a[0] == y[0] for a in w.split("|")) else 0.0
            else:
                s = 2.0 if y in w.split("|") else 0.0
            if s > best:
                best, hit = s, j
        if hit < 0:
            score -= 8
        else:
            score += best
            rest.pop(hit)
    score -= 0.5 * len(rest)
    if organisation:
        score += (1.0 if legal == other_legal else -2.5) if legal and other_legal else (-0.3 if legal or other_legal else 0.0)
    return score


_SEP = "\x1f"
#: What a shared form of each level is worth at most: as written or by sound of the whole name, by sound, with a letter left out.
_BASE = {0: 10.0, 1: 10.0, 2: 5.0, 3: 4.0, 4: 0.0}
#: The form of the names without a rare part.
_NO_CORE = "4"


def generic_words(names: DataFrame) -> list[str]:
    """Words in at least GENERIC_SHARE of the entities, from names(entity, name)."""
    words = names.select("entity", F.explode(F.array_distinct(F.split(F.lower("name"), r"[\W_]+"))).alias("w")).where("length(w) > 1").distinct()
    least = max(GENERIC_LEAST, GENERIC_SHARE * names.select("entity").distinct().count())
    found = [r[0] for r in words.groupBy("w").count().where(F.col("count") >= least).select("w").collect()]
    return sorted(w for w in found if w not in LEGAL and w not in HONORIFICS)


def parsed(names: DataFrame, id_cols: list[str], rules: tuple[list[str], dict[str, str] | None], with_forms: bool) -> DataFrame:
    """id_cols, name -> core, words, legal, whole and forms array<string> (form, then 'w' where it is of the wide core)."""
    schema = ", ".join([f"{c} {names.schema[c].dataType.simpleString()}" for c in id_cols] + ["core string, words string, wide_words string, legal string, whole string, forms array<string>"])
    sent = names.sparkSession.sparkContext.broadcast(rules)

    def run(frames):
        rules = Rules(*sent.value)
        for pdf in frames:
            rows = [rules.parse(n) for n in pdf["name"]]
            out = pdf[id_cols].copy()
            for c in ("core", "legal", "whole"):
                out[c] = [r[c] for r in rows]
            out["words"] = [_SEP.join(r["words"]) for r in rows]
            out["wide_words"] = [_SEP.join(r["wide_words"]) for r in rows]
            out["forms"] = [["0" + r["whole"], *forms(r["core"], r["words"]), *([_NO_CORE] if r["words"] and not r["core"] else []), *("w" + f for f in forms(r["wide_core"], r["wide_words"]))] if with_forms else [] for r in rows]
            yield out

    return names.select(*id_cols, "name").mapInPandas(run, schema)


@F.pandas_udf(DoubleType())
def _agree(words: pd.Series, legal: pd.Series, other: pd.Series, other_legal: pd.Series, organisation: pd.Series) -> pd.Series:
    cut = lambda s: s.split(_SEP) if s else []
    return pd.Series(np.array([agreement(cut(a), b, cut(c), d, e) for a, b, c, d, e in zip(words, legal, other, other_legal, organisation, strict=True)], float))


def _words(words: Column) -> Column:
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, _SEP))


def _first(words: Column | str, lead: str) -> Column:
    return F.concat(F.lit(lead), F.substring(words, 1, 1))


def _word_keys(w: Column) -> Column:
    """The keys by which a surface's word meets every word that `agreement` counts as its counterpart."""
    alternatives = F.split(w, r"\|")
    full = F.concat(F.array(F.concat(F.lit("="), w)), F.transform(alternatives, lambda a: F.concat(F.lit("="), a)), F.transform(alternatives, lambda a: _first(a, "i")))
    return F.array_distinct(F.when(F.endswith(w, F.lit(".")), F.array(F.concat(F.lit("="), w), _first(w, "f"))).otherwise(full))


def _shape_keys(words: Column) -> Column:
    """The keys of an entity's words; one empty key where it has none."""
    of = lambda y: F.array(F.concat(F.lit("="), y), F.when(F.endswith(y, F.lit(".")), _first(y, "i")).otherwise(_first(y, "f")))
    return F.when(words == "", F.array(F.lit(""))).otherwise(F.array_distinct(F.flatten(F.transform(_words(words), of))))


_SHAPE = ["their_words", "their_legal", "organisation"]


def _met_in_common_forms(theirs: DataFrame, held: DataFrame, scratch: Scratch) -> DataFrame:
    """(surface, wide, form, df, shape, low, high) of the pairs in common forms that can reach LEAST_SCORE.

    theirs(surface, wide, used, form), held(form, df, shape, low, high).
    """
    base = F.create_map(*[F.lit(x) for kv in _BASE.items() for x in kv])[F.substring("form", 1, 1).cast("int")]
    out = ["surface", "wide", "form", "df", *_SHAPE, "low", "high"]
    alone = held.groupBy("form", "df", F.size(_words(F.col("their_words"))).alias("n"), "their_legal", "organisation").agg(F.min("their_words").alias("their_words"), F.min("low").alias("low"), F.max("high").alias("high"))
    bare = merge_join(theirs.where("used = ''"), alone, "form").select(out)

    keyed = held.withColumn("key", F.explode(_shape_keys(F.col("their_words"))))
    often = keyed.groupBy("form", "key").agg(F.count("*").alias("often"))
    word = theirs.where("used <> ''").withColumn("n", F.size(_words(F.col("used")))).withColumn("spare", F.floor((base + 1 - LEAST_SCORE + 3 * F.col("n")) / 11))
    word = word.select("surface", "wide", "form", "spare", F.posexplode(_words(F.col("used"))).alias("at", "w")).withColumn("key", F.explode(_word_keys(F.col("w"))))
    word = scratch.stage(merge_join(word, often, ["form", "key"], "left").drop("w"), "words")
    rank = Window.partitionBy("surface", "wide", "form").orderBy("often", "at")
    rarest = word.groupBy("surface", "wide", "form", "spare", "at").agg(F.coalesce(F.sum("often"), F.lit(0)).alias("often")).withColumn("rn", F.row_number().over(rank)).where("rn <= spare + 1")
    asked = merge_join(word.where("often is not null"), rarest.select("surface", "wide", "form", "at"), ["surface", "wide", "form", "at"], "left_semi").select("surface", "wide", "form", "key")
    asked = asked.unionByName(theirs.where("used <> ''").select("surface", "wide", "form", F.lit("").alias("key"))).distinct()
    return bare.unionByName(merge_join(asked, keyed, ["form", "key"]).select(out))


def link_surfaces(surfaces: DataFrame, names: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """(surface, entity, score) for the surfaces that name one entity.

    surfaces(surface): distinct strings. names(entity, name, canonical boolean, organisation boolean). nicknames: full name ->
    its nicknames by spaces, in place of NICKNAMES; a list small enough to be sent to every task.
    """
    with Scratch() as scratch:
        return Stage(_link(surfaces, names, nicknames, scratch), "linked").df


def _link(surfaces: DataFrame, names: DataFrame, nicknames: dict[str, str] | None, scratch: Scratch) -> DataFrame:
    generic = (generic_words(names.where("canonical")), nicknames)
    named = names.where("name is not null").groupBy("entity", "name").agg(F.max("organisation").alias("organisation"))
    known = scratch.stage(parsed(named, ["entity", "organisation"], generic, True), "names")
    own = known.select("entity", F.col("words").alias("their_words"), F.col("legal").alias("their_legal"), "organisation", F.explode("forms").alias("form"))
    own = scratch.stage(own.where("not startswith(form, 'w')").distinct(), "own")
    n_entities = own.select("entity").distinct().count()
    entities_of = own.select("form", "entity").distinct().groupBy("form").agg(F.count("*").alias("df"))
    shapes = own.groupBy("form", *_SHAPE).agg(F.min("entity").alias("low"), F.max("entity").alias("high"))
    common = shapes.groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("form", F.lit(True).alias("common"))
    held = scratch.stage(merge_join(merge_join(shapes, entities_of, "form"), common, "form", "left").withColumn("common", F.coalesce("common", F.lit(False))), "shapes")

    asked = scratch.stage(parsed(surfaces.select("surface", F.col("surface").alias("name")), ["surface"], generic, True), "surfaces")
    wide = F.startswith("f", F.lit("w"))
    theirs = asked.select("surface", "words", "wide_words", F.explode("forms").alias("f"))
    theirs = theirs.select("surface", wide.alias("wide"), F.when(wide, F.col("wide_words")).otherwise(F.col("words")).alias("used"), F.when(wide, F.expr("substr(f, 2)")).otherwise(F.col("f")).alias("form"))
    met = merge_join(theirs.drop("used"), held.where("not common").drop("common"), "form").select("surface", "wide", "form", "df", *_SHAPE, "low", "high")
    hot = held.where("common").drop("common")
    if hot.limit(1).count():
        in_common = scratch.stage(merge_join(theirs, hot.select("form").distinct(), "form", "left_semi"), "common")
        met = met.unionByName(_met_in_common_forms(in_common, hot, scratch))
    base = F.create_map(*[F.lit(x) for kv in _BASE.items() for x in kv])[F.substring("form", 1, 1).cast("int")]
    # the rarity of a form: minus the logarithm of the share of entities that reach it, 1 where one alone does and 0 where all do
    rarity = 1 - F.log2("df") / math.log2(max(2, n_entities))
    met = met.withColumn("entity", F.explode(F.array_distinct(F.array("low", "high")))).groupBy("surface", "entity", "wide", *_SHAPE).agg(F.max(base * rarity).alias("base"))

    pairs = merge_join(met, asked.select("surface", "words", "wide_words", "legal"), "surface")
    used = F.when(F.col("wide"), F.col("wide_words")).otherwise(F.col("words"))
    scored = pairs.withColumn("score", F.col("base") + _agree(used, "legal", "their_words", "their_legal", "organisation"))
    best = scored.groupBy("surface", "entity").agg(F.max("score").alias("score")).where(F.col("score") >= LEAST_SCORE)
    w = Window.partitionBy("surface").orderBy(F.desc("score"), "entity")
    top = best.withColumn("next", F.lead("score").over(w)).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return top.where(F.col("next").isNull() | (F.col("score") - F.col("next") >= MARGIN)).select("surface", "entity", "score")


def link_mentions(mentions: DataFrame, names: DataFrame, id_col: str, surface_col: str) -> DataFrame:
    """(id_col, entity, score) of every mention whose surface names one entity."""
    rows = mentions.select(id_col, F.col(surface_col).alias("surface")).where("surface is not null")
    counts = rows.groupBy("surface").agg(F.count("*").alias("n"))
    counts = Stage(counts, "counts").df
    linked = link_surfaces(counts.select("surface"), names)
    return skew_join(rows, linked, counts, ["surface"], "n").select(id_col, "entity", "score")


def entity_names(entities: DataFrame) -> DataFrame:
    """(entity, name, canonical, organisation) from canonical_name, name_variants (JSON array) and aliases."""
    org = (F.lower(F.trim("entity_type")) != "person") | F.col("entity_type").isNull()
    every = F.concat(
        F.array(F.struct(F.col("canonical_name").alias("name"), F.lit(True).alias("canonical"))),
        *[F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(False).alias("canonical"))) for a in (F.from_json("name_variants", "array<string>"), F.col("aliases"))],
    )
    return entities.select(F.col("unique_entity_id").alias("entity"), org.alias("organisation"), F.inline(every)).where("name is not null and entity is not null")
