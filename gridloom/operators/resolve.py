"""Entity resolution: pairwise similarity and the clusters it makes.

Every method returns (node_id, cluster_id) of nodes in clusters of two or more. Equal keys are grouped before pairs are
formed, and pairs come from joins that cannot lose one at the threshold:

* string similarity at ratio t: all pairs whose lengths fit in blocks, compared by the bits of their letters and bigrams first,
  of which at most 1 - t of their letters and three times as many bigrams can differ;
* neighbourhoods at Jaccard j: two sets must share one of their rarest members, rarest first (prefix filter);
* vectors: all pairs in matrix blocks, the vectors themselves cut into blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.similarity import jaro_winkler_levels, jaro_winkler_similarity, near_indel, ratio
from gridloom.functions.text import normalize_name, token_jaccard, token_sort, words
from gridloom.operators.components import connected_components
from gridloom.session import Stage, merge_join, running_before


def clusters_of(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node_id, cluster_id)."""
    return connected_components(links, "a", "b").select(F.col("node").alias("node_id"), F.col("component").alias("cluster_id"))


def star_links(df: DataFrame, keys: list[str], node: str) -> DataFrame:
    """(a, b): every member of a group linked to the group's smallest; no pairs inside the group."""
    low = df.groupBy(*keys).agg(F.min(node).alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return df.join(low, keys).where(F.col("a") != F.col(node)).select("a", F.col(node).alias("b"))


def exact_clusters(mentions: DataFrame, name: str = "name", keys: tuple[str, ...] = ()) -> DataFrame:
    """Equal normalised names, without regard to type unless keys say so."""
    named = mentions.select("node_id", *keys, normalize_name(F.col(name)).alias("norm")).where("norm <> ''")
    return clusters_of(star_links(named, ["norm", *keys], "node_id"))


def near_texts(texts: DataFrame, threshold: float, block: list[str], size: int | None = None) -> DataFrame:
    """(block..., left, right, score): pairs of distinct texts of texts(block..., text) with an Indel ratio of at least threshold.

    Texts lie in the order of their block and length, cut into pieces of `size` rows; two pieces meet in one task if they share a
    block and lengths that fit the threshold. Every such pair of texts is compared, first by bits: quadratic, but nothing is
    written for a pair that is not near.
    """
    t, spark = threshold / 100, texts.sparkSession
    rows = Stage(texts.where("text <> ''").dropna(subset=block).select(*block, "text").distinct().withColumn("n", F.length("text")), "texts").df
    size = size or min(16_000, max(1_000, rows.count() // 24))
    ranked = running_before(rows.withColumn("one", F.lit(1)), [*block, "n", "text"], "one", "before")
    placed = Stage(ranked.select(*block, "text", F.floor(F.col("before") / size).cast("int").alias("b"), "n"), "placed").df
    edge = F.struct(*block, "n")
    ends = sorted(placed.groupBy("b").agg(F.min(edge).alias("low"), F.max(edge).alias("high")).collect())
    last = list(range(len(ends)))
    for k, (_, _, high) in enumerate(ends):
        # only the last block of a piece goes on in later ones, in which lengths grow
        while last[k] + 1 < len(ends):
            low = ends[last[k] + 1]["low"]
            if low[:-1] != high[:-1] or 2 * high["n"] < t * (high["n"] + low["n"]) - 1e-9:
                break
            last[k] += 1
    first = list(range(len(ends)))
    for k in reversed(range(len(ends))):
        for j in range(k + 1, last[k] + 1):
            first[j] = k
    reach = spark.createDataFrame([(k, first[k], last[k]) for k in range(len(ends))], "b int, first int, last int")
    spread = placed.drop("n").join(F.broadcast(reach), "b")
    ours = spread.select(*block, "text", F.col("b").alias("i"), F.explode(F.sequence("b", "last")).alias("j"), F.lit(True).alias("own"))
    theirs = spread.where("first < b").select(*block, "text", F.explode(F.sequence("first", F.col("b") - 1)).alias("i"), F.col("b").alias("j"), F.lit(False).alias("own"))
    met = sum(j - k + 1 for k, j in enumerate(last))
    # a fixed number of partitions: the rows are few bytes but many pairs, so merging small partitions would cost
    parts = max(1, min(met, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    both = ours.unionByName(theirs).repartition(parts, "i", "j")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = [rows.iloc[:0][block].assign(left=pd.Series(dtype=object), right=pd.Series(dtype=object), score=pd.Series(dtype=float))]
        alone = rows["i"].iat[0] == rows["j"].iat[0]
        for _, part in rows.groupby(block, sort=False):
            if len(part) < 2:
                continue
            x, y = part.loc[part["own"], "text"].to_list(), part.loc[~part["own"], "text"].to_list()
            i, j, score = near_indel(x, None if alone else y, threshold)
            if len(i):
                y = x if alone else y
                key = {c: part[c].iat[0] for c in block}
                out.append(pd.DataFrame({**key, "left": [x[k] for k in i], "right": [y[k] for k in j], "score": score}))
        return pd.concat(out)

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.select(*block).dtypes)
    near = both.groupBy("i", "j").applyInPandas(compare, f"{kinds}, left string, right string, score double")
    return Stage(near.select(*block, F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "score"), "near").df


def fuzzy_links(mentions: DataFrame, threshold: float = 90.0, by_type: bool = True, equal_shortcut: bool = True) -> DataFrame:
    """Links of mentions whose normalised names are equal or whose sorted words reach the ratio."""
    kind = F.coalesce("type", F.lit("Unknown")) if by_type else F.lit("")
    named = Stage(mentions.select("node_id", kind.alias("kind"), normalize_name(F.col("name")).alias("norm")).where("norm <> ''").withColumn("text", token_sort(F.col("norm"))), "named").df
    same = star_links(named, ["kind", "text"], "node_id")
    near = near_texts(named.select("kind", "text"), threshold, ["kind"])
    low = named.groupBy("kind", "text").agg(F.min("node_id").alias("node_id"))
    a = low.select("kind", F.col("text").alias("left"), F.col("node_id").alias("a"))
    b = low.select("kind", F.col("text").alias("right"), F.col("node_id").alias("b"))
    across = near.join(a, ["kind", "left"]).join(b, ["kind", "right"]).select("a", "b")
    return same.unionByName(across)


def fuzzy_clusters(mentions: DataFrame, threshold: float = 90.0, by_type: bool = True) -> DataFrame:
    return clusters_of(fuzzy_links(mentions, threshold, by_type))


#: What the closure method compares beside names.
TEXT_ATTRIBUTES = ("role", "title", "position", "company", "organization")
EXACT_ATTRIBUTES = ("id", "email", "phone", "din", "pan", "registration_id")


def closure_score(a: str, b: str, text: tuple[str, ...], exact: tuple[str, ...]) -> Column:
    """Weighted mean over what both sides have: name ratio (2), text ratios (1), equal identifiers (1); 0 without any."""
    terms = []
    for name, weight in (("name", 2.0), *((t, 1.0) for t in text)):
        x, y = F.lower(F.col(f"{a}.{name}")), F.lower(F.col(f"{b}.{name}"))
        both = (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
        terms.append((both, ratio(x, y) / 100, weight))
    for name in exact:
        x, y = F.lower(F.col(f"{a}.{name}")), F.lower(F.col(f"{b}.{name}"))
        both = (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
        terms.append((both, (x == y).cast("double"), 1.0))
    total = sum((F.when(k, s * w).otherwise(0.0) for k, s, w in terms), F.lit(0.0))
    weights = sum((F.when(k, w).otherwise(0.0) for k, s, w in terms), F.lit(0.0))
    return F.when(weights > 0, total / weights).otherwise(0.0)


def _there(mentions: DataFrame, fields: tuple[str, ...]) -> tuple[str, ...]:
    """The fields that any record fills."""
    if not fields:
        return ()
    n = mentions.agg(*[F.count(F.nullif(F.col(f), F.lit(""))).alias(f) for f in fields]).first()
    return tuple(f for f in fields if n[f])


def closure_links(mentions: DataFrame, threshold: float = 0.85, text: tuple[str, ...] = (), exact: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, score): pairs of one type whose score reaches the threshold, among records that differ in any compared field.

    Equal records are grouped first and linked to one of them; fields that no record has are left out. With k text fields a name
    may be as unlike as (threshold * (2 + k) - k) / 2; names are joined at that ratio. Records of one identifier, which
    may be less alike, are joined inside it at the ratio that e equal identifiers leave.
    """
    text, exact = _there(mentions, text), _there(mentions, exact)
    fields = ["name", *text, *exact]
    base = mentions.select("node_id", F.coalesce("type", F.lit("Unknown")).alias("kind"), *fields).where("name is not null and name <> ''")
    low = [F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in fields]
    distinct = Stage(base.select("node_id", "kind", *low).groupBy("kind", *fields).agg(F.min("node_id").alias("node_id")), "records").df
    k = len(text)
    bound = 100 * (threshold * (2 + k) - k) / 2
    near = near_texts(distinct.select("kind", F.col("name").alias("text")), bound, ["kind"]).select("kind", "left", "right")
    a = distinct.select("kind", F.col("name").alias("left"), F.col("node_id").alias("a"))
    b = distinct.select("kind", F.col("name").alias("right"), F.col("node_id").alias("b"))
    pairs = near.join(a, ["kind", "left"]).join(b, ["kind", "right"]).select("a", "b")
    same = a.join(b.withColumnRenamed("right", "left"), ["kind", "left"]).where("a < b").select("a", "b")
    pairs = pairs.unionByName(same)
    e = len(exact)
    inner = 100 * (threshold * (2 + k + e) - k - e) / 2
    for f in exact:
        keyed = distinct.where(F.col(f) != "").select("kind", f, "node_id", "name")
        ours, theirs = keyed.select("kind", f, F.col("name").alias("left"), F.col("node_id").alias("a")), keyed.select("kind", f, F.col("name").alias("right"), F.col("node_id").alias("b"))
        if inner >= 50:  # below that a shared bigram tells too little
            alike = near_texts(keyed.select("kind", f, F.col("name").alias("text")), inner, ["kind", f]).select("kind", f, "left", "right")
            met = alike.join(ours, ["kind", f, "left"]).join(theirs, ["kind", f, "right"])
        else:
            met = ours.join(theirs, ["kind", f]).where("a < b")
        pairs = pairs.unionByName(met.select("a", "b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rec = distinct.select("node_id", F.struct(*fields).alias("rec"))
    full = pairs.join(rec.select(F.col("node_id").alias("a"), F.col("rec").alias("x")), "a").join(rec.select(F.col("node_id").alias("b"), F.col("rec").alias("y")), "b")
    return full.withColumn("score", closure_score("x", "y", text, exact)).where(F.col("score") >= threshold).select("a", "b", "score")


def closure_clusters(mentions: DataFrame, threshold: float = 0.85, text: tuple[str, ...] = (), exact: tuple[str, ...] = ()) -> DataFrame:
    """The fixpoint of merging clusters with any pair at the threshold: components of the threshold graph."""
    text, exact = _there(mentions, text), _there(mentions, exact)
    fields = ["name", *text, *exact]
    keyed = mentions.where("name is not null and name <> ''").select("node_id", F.coalesce("type", F.lit("Unknown")).alias("kind"), *[F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in fields])
    same = star_links(keyed, ["kind", *fields], "node_id")
    return clusters_of(closure_links(mentions, threshold, text, exact).select("a", "b").unionByName(same))


# ---------------------------------------------------------------- neighbourhoods


def neighbour_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, other): distinct neighbours in either direction."""
    both = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("other")))
    return both.distinct().join(nodes.select("node_id"), "node_id", "left_semi")


def topological_links(nodes: DataFrame, edges: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, score): 0.7 Jaccard of neighbours + 0.3 Jaccard of name words; by words alone for nodes without neighbours.

    Nodes with equal neighbour sets always match (0.7), so each set is one class linked to its smallest node. Different
    sets need a Jaccard of at least (threshold - 0.3) / 0.7 and meet in one of their rarest neighbours.
    """
    if not 0.3 < threshold <= 0.7:
        raise ValueError("candidates are complete only for 0.3 < threshold <= 0.7")
    kinds = nodes.select("node_id", F.coalesce("type", F.lit("Unknown")).alias("kind"), F.coalesce("name", F.lit("")).alias("name"))
    near = Stage(neighbour_lists(nodes, edges), "neighbours").df
    sets = near.groupBy("node_id").agg(F.array_sort(F.collect_set("other")).alias("ns")).join(kinds, "node_id").withColumn("sig", F.sha2(F.concat_ws(",", "ns"), 256))
    sets = Stage(sets, "sets").df
    same = star_links(sets, ["kind", "sig"], "node_id").withColumn("score", F.lit(None).cast("double"))
    j = (threshold - 0.3) / 0.7
    classes = sets.groupBy("kind", "sig").agg(F.first("ns").alias("ns"))
    member = classes.select("kind", "sig", F.size("ns").alias("n"), F.explode("ns").alias("other"))
    df = member.groupBy("kind", "other").agg(F.count("*").alias("df"))
    w = Window.partitionBy("kind", "sig").orderBy("df", "other")
    head = member.join(df, ["kind", "other"]).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.col("n") - F.ceil(F.col("n") * j - 1e-9) + 1).select("kind", "sig", "n", "other")
    pair = head.alias("l").join(head.alias("r"), ["kind", "other"]).where("l.sig < r.sig and l.n >= %f * r.n and r.n >= %f * l.n" % (j, j)).select("kind", F.col("l.sig").alias("s1"), F.col("r.sig").alias("s2")).distinct()
    c = classes.select("kind", "sig", "ns")
    full = pair.join(c.select("kind", F.col("sig").alias("s1"), F.col("ns").alias("x")), ["kind", "s1"]).join(c.select("kind", F.col("sig").alias("s2"), F.col("ns").alias("y")), ["kind", "s2"])
    jac = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    close = full.withColumn("jac", jac).where(F.col("jac") >= j - 1e-9).select("kind", "s1", "s2", "jac")
    # members of a class are linked already: of those with one name the smallest stands for all
    m = sets.groupBy("kind", "sig", "name").agg(F.min("node_id").alias("node_id"))
    across = close.join(m.select("kind", F.col("sig").alias("s1"), F.col("node_id").alias("a"), F.col("name").alias("na")), ["kind", "s1"]).join(m.select("kind", F.col("sig").alias("s2"), F.col("node_id").alias("b"), F.col("name").alias("nb")), ["kind", "s2"])
    across = across.withColumn("score", 0.7 * F.col("jac") + 0.3 * token_jaccard(F.col("na"), F.col("nb"))).where(F.col("score") >= threshold - 1e-9).select("a", "b", "score")
    alone = kinds.join(near.select("node_id").distinct(), "node_id", "left_anti").where("trim(name) <> ''")
    return same.unionByName(across).unionByName(name_links(alone, threshold))


def name_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): Jaccard of lower-case name words within a kind, for nodes(node_id, kind, name)."""
    bag = nodes.withColumn("ws", F.array_sort(F.array_distinct(words(F.lower("name"))))).withColumn("sig", F.concat_ws(" ", "ws")).where("sig <> ''")
    bag = Stage(bag, "bags").df
    same = star_links(bag, ["kind", "sig"], "node_id").withColumn("score", F.lit(1.0))
    classes = bag.groupBy("kind", "sig").agg(F.first("ws").alias("ws"), F.min("node_id").alias("node_id"))
    member = classes.select("kind", "sig", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    df = member.groupBy("kind", "w").agg(F.count("*").alias("df"))
    w = Window.partitionBy("kind", "sig").orderBy("df", "w")
    head = member.join(df, ["kind", "w"]).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    pair = head.alias("l").join(head.alias("r"), ["kind", "w"]).where("l.sig < r.sig").select("kind", F.col("l.sig").alias("s1"), F.col("r.sig").alias("s2")).distinct()
    c = classes.select("kind", "sig", "node_id", "ws")
    full = pair.join(c.select("kind", F.col("sig").alias("s1"), F.col("node_id").alias("a"), F.col("ws").alias("x")), ["kind", "s1"]).join(c.select("kind", F.col("sig").alias("s2"), F.col("node_id").alias("b"), F.col("ws").alias("y")), ["kind", "s2"])
    score = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return same.unionByName(full.withColumn("score", score).where(F.col("score") >= threshold - 1e-9).select("a", "b", "score"))


def topological_clusters(nodes: DataFrame, edges: DataFrame, threshold: float = 0.7) -> DataFrame:
    return clusters_of(topological_links(nodes, edges, threshold).select("a", "b"))


# ---------------------------------------------------------------- vectors


def semantic_pairs(vectors: DataFrame, threshold: float = 0.9, top_k: int = 20, blocks: int | None = None) -> DataFrame:
    """(a, b, score): per vector the top_k by cosine (itself included) at or above the threshold, without regard to type.

    vectors(node_id, vector). Rows are dealt into blocks and every pair of blocks is one matrix product in one task; blocks
    grow in number with the rows, not in size.
    """
    rows = Stage(vectors.where("vector is not null").select("node_id", "vector"), "vectors").df
    n = rows.count()
    blocks = blocks or max(1, math.ceil(n / 4000))
    block = F.pmod(F.xxhash64("node_id"), F.lit(blocks)).cast("int")
    numbered = rows.withColumn("b", block)
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = numbered.select(F.col("b").alias("i"), F.explode(every).alias("j"), "node_id", "vector")
    right = numbered.select(F.explode(every).alias("i"), F.col("b").alias("j"), "node_id", "vector")

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": pd.Series([], dtype=str), "b": pd.Series([], dtype=str), "score": pd.Series([], dtype=float)})
        p, q = (np.stack([np.asarray(v, np.float64) for v in d["vector"]]) for d in (x, y))
        p, q = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (p, q))
        ids, other = x["node_id"].to_numpy(), y["node_id"].to_numpy()
        out = []
        for s in range(0, len(p), 512):
            sims = p[s : s + 512] @ q.T
            k = min(top_k, sims.shape[1])
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            score = np.take_along_axis(sims, top, 1)
            i, j = np.nonzero(score >= threshold - 1e-9)
            out.append(pd.DataFrame({"a": ids[s + i], "b": other[top[i, j]], "score": score[i, j]}))
        return pd.concat(out)

    near = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(product, "a string, b string, score double")
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return near.withColumn("rn", F.row_number().over(w)).where((F.col("rn") <= top_k) & (F.col("score") >= threshold) & (F.col("a") != F.col("b"))).drop("rn")


def semantic_clusters(vectors: DataFrame, threshold: float = 0.9, top_k: int = 20) -> DataFrame:
    return clusters_of(semantic_pairs(vectors, threshold, top_k).select("a", "b"))


def average_linkage(x: np.ndarray, threshold: float) -> np.ndarray:
    """Average-linkage clustering of one bounded group by cosine, cut at 1 - threshold; labels per row."""
    n = len(x)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    label, size = np.arange(n), np.ones(n)
    while n > 1:
        i, j = divmod(int(d.argmin()), len(d))
        if d[i, j] > 1 - threshold:
            break
        i, j = min(i, j), max(i, j)
        d[i] = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return label


# ---------------------------------------------------------------- probabilistic linkage


def comparison_levels(a: str, b: str, fuzzy: dict[str, tuple[float, ...]], exact: tuple[str, ...]) -> list[Column]:
    """Per column the level of agreement: -1 where a side is blank, 0 for none, then one per threshold, the top for equality."""
    out = []
    for c, cuts in fuzzy.items():
        x, y = F.col(f"{a}_{c}"), F.col(f"{b}_{c}")
        jw = jaro_winkler_similarity(x, y)
        level = F.lit(0)
        for k, cut in enumerate(sorted(cuts), 1):
            level = F.when(jw >= cut, k).otherwise(level)
        out.append(F.when((x == "") | (y == ""), -1).when(x == y, len(cuts) + 1).otherwise(level).cast("int").alias(f"g_{c}"))
    for c in exact:
        x, y = F.col(f"{a}_{c}"), F.col(f"{b}_{c}")
        out.append(F.when((x == "") | (y == ""), -1).when(x == y, 1).otherwise(0).cast("int").alias(f"g_{c}"))
    return out


def blocked_pairs(records: DataFrame, rules: list[list[Column]], columns: list[str]) -> DataFrame:
    """Pairs (l_id, r_id and the columns of both) that agree on all keys of any rule, each once."""
    pairs = None
    for rule in rules:
        keyed = records.select("node_id", *[k.alias(f"k{i}") for i, k in enumerate(rule)])
        on = [f"k{i}" for i in range(len(rule))]
        part = keyed.withColumnRenamed("node_id", "l_id").join(keyed.withColumnRenamed("node_id", "r_id"), on).where("l_id < r_id").select("l_id", "r_id")
        pairs = part if pairs is None else pairs.unionByName(part)
    side = lambda p: records.select(F.col("node_id").alias(f"{p}_id"), *[F.coalesce(c, F.lit("")).alias(f"{p}_{c}") for c in columns])
    return pairs.distinct().join(side("l"), "l_id").join(side("r"), "r_id")


def pattern_counts(pairs: DataFrame, levels: list[Column]) -> DataFrame:
    """How many pairs show each pattern of agreement: all that estimation needs."""
    names = [f"g{i}" for i in range(len(levels))]
    g = pairs.select(*[c.alias(n) for c, n in zip(levels, names, strict=True)])
    return g.groupBy(*names).agg(F.count("*").alias("n_pairs"))


def estimate(patterns: np.ndarray, counts: np.ndarray, prior: float = 1e-4, rounds: int = 25, tolerance: float = 1e-4) -> dict:
    """Fellegi-Sunter by EM over pattern counts; blanks (-1) say nothing. Returns prior, m, u per column and the log-likelihoods."""
    k = patterns.shape[1]
    tops = [int(patterns[:, c].max(initial=0)) + 1 for c in range(k)]
    m = [np.full(t, 0.1 / max(t - 1, 1)) for t in tops]
    u = [np.full(t, 0.1 / max(t - 1, 1)) for t in tops]
    for c in range(k):
        m[c][-1] = 0.9
        u[c][0] = 0.9
        m[c], u[c] = m[c] / m[c].sum(), u[c] / u[c].sum()
    history = []
    for _ in range(rounds):
        pm, pu = np.full(len(counts), prior), np.full(len(counts), 1 - prior)
        for c in range(k):
            known = patterns[:, c] >= 0
            pm[known] *= m[c][patterns[known, c]]
            pu[known] *= u[c][patterns[known, c]]
        history.append(float((counts * np.log(pm + pu)).sum()))
        match = pm / (pm + pu)
        fresh = float((counts * match).sum() / counts.sum())
        moved = abs(fresh - prior)
        prior = fresh
        for c in range(k):
            known = patterns[:, c] >= 0
            for weights, target in ((counts * match, m), (counts * (1 - match), u)):
                got = np.bincount(patterns[known, c], weights[known], minlength=tops[c])
                new = (got + 1e-9) / (got.sum() + 1e-9 * tops[c])
                moved = max(moved, float(np.abs(new - target[c]).max()))
                target[c] = new
        if moved < tolerance:
            break
    return {"prior": prior, "m": m, "u": u, "log_likelihood": history}


def match_probability(patterns: np.ndarray, model: dict) -> np.ndarray:
    pm, pu = np.full(len(patterns), model["prior"]), np.full(len(patterns), 1 - model["prior"])
    for c in range(patterns.shape[1]):
        known = patterns[:, c] >= 0
        at = np.minimum(patterns[known, c], len(model["m"][c]) - 1)
        pm[known] *= model["m"][c][at]
        pu[known] *= model["u"][c][at]
    return pm / (pm + pu)


def probabilistic_pairs(records: DataFrame, fuzzy: dict[str, tuple[float, ...]], exact: tuple[str, ...], rules: list[list[Column]], threshold: float = 0.8, prior: float = 1e-4) -> DataFrame:
    """(l_id, r_id, match_probability) of blocked pairs at or above the threshold; the driver sees pattern counts only."""
    columns = [*fuzzy, *exact]
    pairs = blocked_pairs(records, rules, columns)
    levels = comparison_levels("l", "r", fuzzy, exact)
    names = [f"g_{c}" for c in columns]
    scored = Stage(pairs.select("l_id", "r_id", *levels), "levels").df
    table = scored.groupBy(*names).agg(F.count("*").alias("n")).toPandas()  # at most the product of the levels
    if table.empty:
        return scored.select("l_id", "r_id", F.lit(0.0).alias("match_probability")).limit(0)
    p = table[names].to_numpy(int)
    table["match_probability"] = match_probability(p, estimate(p, table["n"].to_numpy(float), prior))
    lookup = records.sparkSession.createDataFrame(table.drop(columns="n"))
    return scored.join(F.broadcast(lookup), names).where(F.col("match_probability") >= threshold).select("l_id", "r_id", "match_probability")


def _block_codes(left: pd.DataFrame, right: pd.DataFrame, fuzzy: dict[str, tuple[float, ...]], exact: tuple[str, ...]):
    """Per row of left (its position, the code of its pattern with each row of right); levels are found once per pair of distinct values."""
    parts = []
    for c in [*fuzzy, *exact]:
        (x, xs), (y, ys) = pd.factorize(left[c]), pd.factorize(right[c])
        cuts = sorted(fuzzy.get(c, ()))
        level = jaro_winkler_levels(list(xs), list(ys), cuts) if cuts else np.zeros((len(xs), len(ys)), np.int8)
        place = {v: j for j, v in enumerate(ys)}
        for i, v in enumerate(xs):
            if v in place:
                level[i, place[v]] = len(cuts) + 1
        level[[i for i, v in enumerate(xs) if v == ""], :] = -1
        level[:, [j for j, v in enumerate(ys) if v == ""]] = -1
        parts.append((x, y, level + 1, len(cuts) + 3))
    for i in range(len(left)):
        code = np.zeros(len(right), np.int32)
        for x, y, level, size in parts:
            code = code * size + level[x[i]][y]
        yield i, code


def linked_by_type(records: DataFrame, fuzzy: dict[str, tuple[float, ...]], exact: tuple[str, ...], kind: Column, threshold: float = 0.8, prior: float = 1e-4, rules: tuple = (), rows: int = 4000) -> DataFrame:
    """(l_id, r_id, match_probability) at or above the threshold of all pairs of one kind, and of the pairs of the rules across kinds.

    Every pair of a kind is compared, in blocks of rows in the order of node_id: quadratic by definition. Model and counts are
    those of all these pairs; blocks return counts of patterns first, and only pairs of patterns above the threshold then.
    """
    columns = [*fuzzy, *exact]
    sizes = [len(fuzzy.get(c, ())) + 3 for c in columns]
    base = records.withColumn("kind", kind)
    filled = base.select("node_id", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in columns]).where("kind is not null and node_id is not null")
    placed = Stage(running_before(filled.withColumn("one", F.lit(1)), ["node_id"], "one", "before").withColumn("b", F.floor(F.col("before") / rows).cast("int")).drop("one", "before"), "placed")
    placed, again = placed.df, records.sparkSession.read.schema(placed.df.schema).parquet(placed.path)  # two readings, so that both can be joined
    last = placed.agg(F.max("b")).first()[0] or 0
    left = placed.select("kind", F.col("b").alias("i"), F.explode(F.sequence("b", F.lit(last))).alias("j"), "node_id", *columns)
    right = again.select("kind", F.explode(F.sequence(F.lit(0), "b")).alias("i"), F.col("b").alias("j"), "node_id", *columns)
    blocks = left.groupBy("kind", "i", "j").cogroup(right.groupBy("kind", "i", "j"))
    total = int(np.prod(sizes))

    def tally(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(total, np.int64)
        if len(x) and len(y):
            ids, diagonal = y["node_id"].to_numpy(), x["i"].iloc[0] == x["j"].iloc[0]
            for i, code in _block_codes(x, y, fuzzy, exact):
                n += np.bincount(code[ids > x["node_id"].iat[i]] if diagonal else code, minlength=total)
        at = x if len(x) else y
        return pd.DataFrame({"kind": at["kind"].iat[0], "i": at["i"].iat[0], "j": at["j"].iat[0], "code": np.flatnonzero(n), "n": n[n > 0]})

    code = F.lit(0)
    for c, size in zip(columns, sizes, strict=True):
        code = code * size + F.col(f"g_{c}") + 1
    seen_in = Stage(blocks.applyInPandas(tally, "kind string, i int, j int, code int, n long"), "tally").df
    counts = seen_in.select("code", "n")
    across = None
    if rules:
        other = base.select("node_id", "kind")
        pairs = blocked_pairs(records, list(rules), columns).join(other.withColumnsRenamed({"node_id": "l_id", "kind": "l_kind"}), "l_id").join(other.withColumnsRenamed({"node_id": "r_id", "kind": "r_kind"}), "r_id")
        pairs = pairs.where("l_kind is null or r_kind is null or l_kind <> r_kind").select("l_id", "r_id", *comparison_levels("l", "r", fuzzy, exact))
        across = Stage(pairs.select("l_id", "r_id", code.alias("code")), "across").df
        counts = counts.unionByName(across.groupBy("code").agg(F.count("*").alias("n")))
    table = counts.groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # at most the product of the levels
    seen = table["code"].to_numpy(np.int64)
    patterns = np.stack(np.unravel_index(seen, sizes), axis=1) - 1 if len(seen) else np.zeros((0, len(sizes)), int)
    found = match_probability(patterns, estimate(patterns, table["n"].to_numpy(float), prior)) if len(seen) else np.zeros(0)
    likely = np.full(total, np.nan)
    likely[seen[found >= threshold]] = found[found >= threshold]

    def emit(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, object), np.zeros(0, object), np.zeros(0))]
        if len(x) and len(y):
            ids = y["node_id"].to_numpy()
            for i, code in _block_codes(x, y, fuzzy, exact):
                own, score = x["node_id"].iat[i], likely[code]
                at = np.flatnonzero(~np.isnan(score))
                at = at[ids[at] > own]
                out.append((np.full(len(at), own, object), ids[at], score[at]))
        a, b, s = (np.concatenate(p) for p in zip(*out, strict=True))
        return pd.DataFrame({"l_id": a, "r_id": b, "match_probability": s})

    # only blocks in which a pattern above the threshold was counted are compared again
    wanted = [int(c) for c in np.flatnonzero(~np.isnan(likely))]
    hit = seen_in.where(F.col("code").isin(wanted)).select("kind", "i", "j").distinct()
    keys = ["kind", "i", "j"]
    blocks = merge_join(left, hit, keys, "left_semi").groupBy(*keys).cogroup(merge_join(right, hit, keys, "left_semi").groupBy(*keys))
    pairs = Stage(blocks.applyInPandas(emit, "l_id string, r_id string, match_probability double"), "linked").df
    if across is None:
        return pairs
    lookup = F.array(*[F.lit(None if np.isnan(v) else float(v)).cast("double") for v in likely])
    return pairs.unionByName(across.select("l_id", "r_id", lookup[F.col("code")].alias("match_probability")).where("match_probability is not null"))


# ---------------------------------------------------------------- resolvers by name


class Resolver:
    """A method with its parameters: the contract resolve(mentions, edges) -> (node_id, cluster_id)."""

    def __init__(self, name: str, run, **params):
        self.name, self._run, self.params = name, run, params

    def resolve(self, mentions: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        return self._run(mentions, edges, **self.params)


def resolvers(ask=None) -> dict[str, Resolver]:
    """The methods of the library with their usual parameters, and with a client (ask, as in model_resolve) the model-assisted one."""
    out = {
        "exact": Resolver("exact", lambda m, e: exact_clusters(m)),
        "fuzzy": Resolver("fuzzy", lambda m, e, threshold: fuzzy_clusters(m, threshold), threshold=90.0),
        "closure": Resolver("closure", lambda m, e, threshold: closure_clusters(m, threshold), threshold=0.85),
        "topological": Resolver("topological", lambda m, e, threshold: topological_clusters(m, e, threshold), threshold=0.7),
        "semantic": Resolver("semantic", lambda m, e, threshold, top_k: semantic_clusters(m, threshold, top_k), threshold=0.9, top_k=20),
        "probabilistic": Resolver(
            "probabilistic",
            lambda m, e, threshold: clusters_of(
                linked_by_type(m, {"name": (0.7, 0.9)}, (), F.coalesce("type", F.lit("Unknown")), threshold).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
            ),
            threshold=0.8,
        ),
    }
    if ask is not None:
        out["model"] = Resolver("model", lambda m, e, size, rounds: model_resolve(m, ask, size, rounds), size=30, rounds=3)
    return out


def model_batches(mentions: DataFrame, size: int = 30) -> DataFrame:
    """(node_id, type, batch): one batch when there are at most `size` mentions, else batches of that size inside a type.

    Mentions are ranked per (type, salt) first, so a type with most mentions is numbered by many tasks; batches then fill
    inside a salt.
    """
    n = mentions.count()
    kind = F.coalesce("type", F.lit("Unknown"))
    if n <= size:
        return mentions.select("node_id", kind.alias("type"), F.lit("all").alias("batch"))
    salts = max(1, n // 100_000)
    salted = mentions.select("node_id", kind.alias("type"), F.pmod(F.xxhash64("node_id"), F.lit(salts)).alias("salt"), "ord")
    w = Window.partitionBy("type", "salt").orderBy("ord", "node_id")
    return salted.withColumn("k", F.floor((F.row_number().over(w) - 1) / size)).select("node_id", "type", F.concat_ws("/", "type", F.col("salt").cast("string"), F.col("k").cast("string")).alias("batch"))


def model_resolve(mentions: DataFrame, ask, size: int = 30, rounds: int = 3) -> DataFrame:
    """Clusters by a model: ask(DataFrame of one batch) -> list of lists of node_id, run per batch on the executors.

    Up to `rounds` reconciliations follow over the first member of each cluster and the nodes without one, until one
    batch is left or nothing new is found.
    """
    schema = "a string, b string"

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        known = set(pdf["node_id"])
        groups = [[m for m in group if m in known] for group in ask(pdf)]
        rows = [(g[0], x) for g in groups for x in g[1:]]
        return pd.DataFrame(rows, columns=["a", "b"], dtype=str)

    active, links = mentions, None
    for _ in range(1 + rounds):
        batches = model_batches(active, size)
        asked = active.drop("type").join(batches, "node_id")
        found = Stage(asked.groupBy("batch").applyInPandas(answer, schema), "answers").df
        links = found if links is None else links.unionByName(found)
        if not found.limit(1).count() or batches.select("batch").distinct().limit(2).count() < 2:
            break
        clusters = clusters_of(links)
        active = Stage(mentions.join(clusters, "node_id", "left").where("cluster_id is null or node_id = cluster_id").drop("cluster_id"), "active").df
    return clusters_of(links)


def merge_groups(groups: DataFrame) -> DataFrame:
    """(group_no, node_id, reasoning): overlapping groups(group_id, node_id, reasoning) as one, with the first group's reasoning.

    Groups of one member say nothing. Results are numbered from 1 in order of their smallest member.
    """
    real = groups.join(groups.groupBy("group_id").agg(F.countDistinct("node_id").alias("n")).where("n > 1").select("group_id"), "group_id", "left_semi")
    clusters = clusters_of(star_links(real.select("group_id", "node_id").distinct(), ["group_id"], "node_id"))
    why = real.join(clusters, "node_id").groupBy("cluster_id").agg(F.min_by("reasoning", "group_id").alias("reasoning"))
    numbered = running_before(why.withColumn("one", F.lit(1)), ["cluster_id"], "one", "before")
    return clusters.join(numbered, "cluster_id").select((F.col("before") + 1).alias("group_no"), "node_id", "reasoning")
