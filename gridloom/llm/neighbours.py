"""Most similar vectors for every vector.

Equal vectors are one item from the start, which keeps its k + 1 smallest ids. A forest of random-projection trees is
fitted on a bounded sample (at most FIT_ROWS items, chosen by hash of the id): a node splits its rows at the median of
their projections on the difference of two of them. Every item of the collection is then routed to one leaf per tree.
Where leaves come out larger than MAX_LEAF, which a sample of bounded size cannot prevent in a large collection, every such
leaf gets a tree of its own, fitted on a sample of at most SUB_ROWS of its items in one task, and its items go on to the leaves
of that. A query descends all trees through one shared priority queue ordered by the smallest margin on the way, until
SEARCH_LEAVES leaves are open, and in an enlarged leaf on through its tree to SUB_LEAVES leaves; inside the leaves all cosines
are computed as block products, the best are computed again in double precision, and the leaves' winners are merged.

The forest and the sizes of its leaves are the only things broadcast; both depend on FIT_ROWS alone. Leaves are gathered
into groups of about GROUP_ROWS rows; the trees of enlarged leaves stay beside their leaf, in blocks of about
GROUP_ROWS rows dealt by hash, and the leaves below them are gathered per leaf, so no task holds an unbounded group.

Defined results: vectors that are null, of another length, zero, or hold a null or non-finite number are not used;
of rows with one id the first by vector counts, and it is a query if any of them is; equal cosines go to the smaller
id; with fewer than k others there are fewer neighbours; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import Scratch, Stage, merge_join

TREES, SEARCH_LEAVES, FIT_ROWS, LEAF_ROWS, LEAST_LEAF, GROUP_ROWS = 10, 40, 65_536, 128, 16, 20_000
#: Items of a leaf from which it gets a tree of its own, the sample that one is fitted on, and its leaves that a query opens.
MAX_LEAF, SUB_ROWS, SUB_LEAVES = 1024, 8192, 4
_SPARE = 4  # beside k, recomputed in double precision


class Tree:
    """Nodes in arrays: normal, offset, children (left, right), or (-1, leaf)."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        normals, offsets, children = [], [], []
        self.leaves = 0
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(children)
            if parent >= 0:
                children[parent][side] = me
            normals.append(np.zeros(x.shape[1], np.float32))
            offsets.append(0.0)
            if len(rows) <= leaf:
                children.append([-1, self.leaves])
                self.leaves += 1
                continue
            a, b = rng.choice(len(rows), 2, replace=False)
            normal = x[rows[a]] - x[rows[b]]
            if not normal.any():
                normal = rng.standard_normal(x.shape[1]).astype(np.float32)
            normal /= np.linalg.norm(normal)
            along = x[rows] @ normal
            cut = np.float32(np.median(along))
            left = along <= cut
            if left.all():  # copies: nothing to split
                children.append([-1, self.leaves])
                self.leaves += 1
                continue
            normals[me], offsets[me] = normal, cut
            children.append([0, 0])
            todo += [(rows[left], me, 0), (rows[~left], me, 1)]
        self.normals = np.array(normals, np.float32)
        self.offsets = np.array(offsets, np.float32)
        self.children = np.array(children, np.int32)

    def route(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while len(i := np.flatnonzero(self.children[at, 0] >= 0)):
            side = (np.einsum("ij,ij->i", x[i], self.normals[at[i]]) > self.offsets[at[i]]).astype(np.int64)
            at[i] = self.children[at[i], side]
        return self.children[at, 1]


def leaf_rows(sample: int, rows: int, least: int = LEAST_LEAF) -> int:
    """Rows of the sample to a leaf for LEAF_ROWS rows of the collection; least makes a median worth its name."""
    return max(least, math.ceil(LEAF_ROWS * sample / max(rows, 1)))


class Forest:
    def __init__(self, x: np.ndarray, leaf: int, trees: int = TREES, seed: int = 42):
        """x: the unit vectors of the sample; leaf: rows of it to a leaf."""
        self.trees = [Tree(x, leaf, np.random.default_rng([seed, t])) for t in range(trees)]
        self.first = np.cumsum([0] + [t.leaves for t in self.trees])

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree, numbered over the forest."""
        return np.stack([t.route(x) + f for t, f in zip(self.trees, self.first, strict=False)], axis=1)

    def search(self, x: np.ndarray, leaves: int) -> list[list[int]]:
        """The leaves that each query opens, by one queue over all trees."""
        out = []
        for start in range(0, len(x), 64):
            block = x[start : start + 64]
            margins = [block @ t.normals.T - t.offsets for t in self.trees]
            for q in range(len(block)):
                queue = [(-math.inf, t, 0) for t in range(len(self.trees))]
                opened: list[int] = []
                while queue and len(opened) < leaves:
                    cost, t, node = heapq.heappop(queue)
                    children, margin = self.trees[t].children, margins[t][q]
                    while True:
                        left, right = children[node]
                        if left < 0:
                            break
                        m = margin[node]
                        near, far = (right, left) if m > 0 else (left, right)
                        heapq.heappush(queue, (max(cost, abs(float(m))), t, int(far)))
                        node = near
                    opened.append(int(right) + int(self.first[t]))
                out.append(opened)
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A binary column of float32 vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    data = np.frombuffer(column.buffers()[2], np.float32) if len(column) else np.zeros(0, np.float32)
    start = column.offset * dim
    return data[start : start + len(column) * dim].reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-300)).astype(np.float32)


def _pack(batches):
    for b in batches:
        flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        n = b.num_rows
        dim = len(flat) // max(n, 1)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim * 4).buffers()[1]
        packed = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(flat.tobytes())])
        yield pa.RecordBatch.from_arrays([b.column(0), packed, b.column(2)], ["id", "v", "query"])


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, query, dim: int) -> DataFrame:
    """(id, v binary, query): one row per id."""
    v = F.col(vector_col)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    one = df.where(v.isNotNull() & F.col(id_col).isNotNull()).where(fine).groupBy(F.col(id_col).alias("id")).agg(F.min(v).alias("v"), F.max(query).alias("query"))
    return one.mapInArrow(_pack, "id string, v binary, query boolean")


def _table(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


_PLACED = "g long, leaf int, id string, v binary"


def _best_in_leaves(left: pa.Table, right: pa.Table, k: int, dim: int) -> pa.Table:
    """(id, neighbour, cosine): the best items of each query of left(leaf, id, v) over the leaves of right(leaf, id, v)."""
    q, x = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim)
    q64, x64 = q.astype(np.float64), x.astype(np.float64)
    q64 /= np.linalg.norm(q64, axis=1, keepdims=True)
    x64 /= np.linalg.norm(x64, axis=1, keepdims=True)
    q32, x32 = q64.astype(np.float32), x64.astype(np.float32)
    ql, xl = left.column("leaf").to_numpy(), right.column("leaf").to_numpy()
    # numbers of ids, equal on both sides and in the order of the ids, to keep a row from being its own neighbour
    names = pa.chunked_array([*left.column("id").chunks, *right.column("id").chunks], pa.string()).combine_chunks().dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[names.indices.to_numpy()]
    ids = names.dictionary.take(pa.array(order))
    qi, xi = codes[: len(ql)], codes[len(ql) :]
    order, qorder = np.lexsort((xi, xl)), np.argsort(ql, kind="stable")
    a, b, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for leaf in np.unique(ql):
        items = order[np.searchsorted(xl, leaf, "left", sorter=order) : np.searchsorted(xl, leaf, "right", sorter=order)]
        asks = qorder[np.searchsorted(ql, leaf, "left", sorter=qorder) : np.searchsorted(ql, leaf, "right", sorter=qorder)]
        step = max(1, min(512, 4_000_000 // max(1, len(items))))
        for cut in range(0, len(asks) if len(items) else 0, step):
            part = asks[cut : cut + step]
            sims = q32[part] @ x32[items].T
            sims[qi[part][:, None] == xi[items][None, :]] = -2
            n = min(k + _SPARE, len(items))
            top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
            exact = np.einsum("id,ijd->ij", q64[part], x64[items[top]])
            exact[np.take_along_axis(sims, top, 1) <= -1.5] = -2
            a.append(np.repeat(qi[part], n))
            b.append(xi[items[top]].ravel())
            s.append(exact.ravel())
    a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
    keep = np.flatnonzero(s > -1.5)
    a, b, s = a[keep], b[keep], s[keep]
    _, once = np.unique(a * len(ids) + b, return_index=True)
    a, b, s = a[once], b[once], s[once]
    best = np.lexsort((b, -s, a))
    a, b, s = a[best], b[best], s[best]
    keep = np.arange(len(a)) - np.searchsorted(a, a, "left") < k + _SPARE
    return pa.table({"id": ids.take(pa.array(a[keep])), "neighbour": ids.take(pa.array(b[keep])), "cosine": pa.array(s[keep])})


def nearest(vectors: DataFrame, k: int, dim: int, trees: int = TREES, search_leaves: int = SEARCH_LEAVES) -> DataFrame:
    """(id, neighbour, cosine, rank) of the query rows of vectors(id, v, query), against all rows."""
    with Scratch() as scratch:
        base = scratch.stage(vectors, "vectors")
        # of the copies of a vector the k + 1 smallest ids are all that any answer can name
        copies = base.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rn") <= k + 1)
        items = scratch.stage(copies.groupBy("v").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids")), "items")
        asked = base.where("query").select("v").distinct()
        near = _near_items(items, merge_join(items.select("id", "v"), asked, "v", "left_semi").select("id", "v"), k, dim, trees, search_leaves, scratch)
        # every query has its own copies first, at cosine 1, and then those of the near items
        named = merge_join(near, items.select(F.col("id").alias("neighbour"), "ids"), "neighbour").select("id", "cosine", "ids")
        own = merge_join(items.select("id", "v", "ids"), asked, "v", "left_semi").select("id", F.lit(1.0).alias("cosine"), "ids")
        flat = named.unionByName(own).select("id", "cosine", F.explode("ids").alias("neighbour"))
        w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
        found = flat.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour"))).alias("found"))
        found = merge_join(items.select("v", F.col("id").alias("item")), found.withColumnRenamed("id", "item"), "item").select("v", "found")
        each = merge_join(base.where("query").select("id", "v"), found, "v").select("id", F.slice(F.filter("found", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("found"))
        out = each.select("id", F.posexplode("found").alias("rank", "f")).select("id", F.col("f.neighbour").alias("neighbour"), (-F.col("f.far")).alias("cosine"), (F.col("rank") + 1).alias("rank"))
        return Stage(out, "nearest").df


def _near_items(items: DataFrame, asks: DataFrame, k: int, dim: int, trees: int, search_leaves: int, scratch: Scratch) -> DataFrame:
    """(id, neighbour, cosine) of the k nearest of items(id, v) for each of asks(id, v)."""
    spark = items.sparkSession
    rows = items.count()
    share = min(1.0, 0.9 * FIT_ROWS / max(rows, 1))
    picked = items.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("v").limit(FIT_ROWS)
    sample = _unit(_matrix(picked.toArrow().column("v"), dim)) if rows else np.zeros((0, dim), np.float32)
    forest = Forest(sample, leaf_rows(len(sample), rows), trees)
    sent = spark.sparkContext.broadcast(forest)

    def route(batches):
        for b in batches:
            leaves = sent.value.leaves_of(_unit(_matrix(b.column(1), dim))).astype(np.int32)
            offsets = pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * leaves.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(leaves.ravel()))], ["id", "v", "leaves"])

    routed = scratch.stage(items.select("id", "v").mapInArrow(route, "id string, v binary, leaves array<int>"), "routed")
    sizes = np.zeros(int(forest.first[-1]), np.int64)  # as many as the forest has leaves
    for leaf, n in routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        sizes[leaf] = n
    large = sizes > MAX_LEAF
    group = np.cumsum(np.where(large, 0, sizes)) // GROUP_ROWS
    plan = spark.sparkContext.broadcast((group, sizes, large))

    def spread(batches):
        for b in batches:
            group, _, large = plan.value
            leaves = b.column(2).flatten().to_numpy()
            of = np.repeat(np.arange(b.num_rows), len(leaves) // max(b.num_rows, 1))
            keep = ~large[leaves]
            take = pa.array(of[keep])
            yield _table(_PLACED, group[leaves[keep]], leaves[keep], b.column(0).take(take), b.column(1).take(take))

    def open_(batches):
        for b in batches:
            opened = sent.value.search(_unit(_matrix(b.column(1), dim)), search_leaves)
            take = pa.array(np.repeat(np.arange(len(opened)), [len(o) for o in opened]))
            yield _table("leaf int, id string, v binary", np.array([leaf for o in opened for leaf in o], np.int32), b.column(0).take(take), b.column(1).take(take))

    opened = asks.select("id", "v").mapInArrow(open_, "leaf int, id string, v binary")
    if large.any():
        opened = scratch.stage(opened, "opened")

    def ask(batches):
        for b in batches:
            group, _, large = plan.value
            leaves = b.column(0).to_numpy()
            rows = np.flatnonzero(~large[leaves])
            keep = pa.array(rows)
            yield _table(_PLACED, group[leaves[rows]], b.column(0).take(keep), b.column(1).take(keep), b.column(2).take(keep))

    placed, queries = routed.mapInArrow(spread, _PLACED), opened.mapInArrow(ask, _PLACED)
    if large.any():
        below, asked = _enlarged(routed, opened, plan, dim, scratch)
        placed, queries = placed.unionByName(below), queries.unionByName(asked)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_in_leaves(left, right, k, dim)

    found = queries.groupBy("g").cogroup(placed.groupBy("g")).applyInArrow(compare, "id string, neighbour string, cosine double")
    once = found.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def _enlarged(routed: DataFrame, opened: DataFrame, plan, dim: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Items and queries of the leaves of more than MAX_LEAF items, placed in the leaves of those leaves' own trees."""

    def share(leaf: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(1.0, SUB_ROWS / plan.value[1][leaf.to_numpy()]))

    def is_large(leaf: pd.Series) -> pd.Series:
        return pd.Series(plan.value[2][leaf.to_numpy()])

    def n_blocks(leaf: pd.Series) -> pd.Series:
        return pd.Series(-(-plan.value[1][leaf.to_numpy()] // GROUP_ROWS))

    share, is_large, n_blocks = F.pandas_udf(share, "double"), F.pandas_udf(is_large, "boolean"), F.pandas_udf(n_blocks, "long")
    inside = routed.select(F.explode("leaves").alias("leaf"), "id", "v").where(is_large("leaf"))
    chosen = inside.where(F.pmod(F.xxhash64("id", "leaf"), F.lit(1 << 20)) < share("leaf") * (1 << 20)).select("leaf", "v")

    def fit(t: pa.Table) -> pa.Table:
        leaf = t.column("leaf")[0].as_py()
        x = _unit(_matrix(t.column("v"), dim))
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "tree": pa.array([pickle.dumps(Forest(x, leaf_rows(len(x), int(plan.value[1][leaf]), 8), 1, leaf))], pa.binary())})

    trees = scratch.stage(chosen.groupBy("leaf").applyInArrow(fit, "leaf int, tree binary"), "trees")
    spread = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks("leaf") - 1)))

    def place(search: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"g": pa.array([], pa.int64()), "leaf": pa.array([], pa.int32()), "id": pa.array([], pa.string()), "v": pa.array([], pa.binary())})
            leaf, forest = left.column("leaf")[0].as_py(), pickle.loads(right.column("tree")[0].as_py())
            x = _unit(_matrix(left.column("v"), dim))
            if search:
                found = forest.search(x, SUB_LEAVES)
                of, sub = np.repeat(np.arange(len(x)), [len(o) for o in found]), np.array([y for o in found for y in o], np.int64)
            else:
                of, sub = np.arange(len(x)), forest.leaves_of(x)[:, 0].astype(np.int64)
            # the leaves below one leaf are gathered as those of the forest are, to about GROUP_ROWS items
            each = max(1, GROUP_ROWS * int(forest.first[-1]) // int(plan.value[1][leaf]))
            g = ((leaf + 1) << 32) + sub // each
            take = pa.array(of)
            return pa.table({"g": pa.array(g), "leaf": pa.array(sub.astype(np.int32)), "id": left.column("id").combine_chunks().take(take), "v": left.column("v").combine_chunks().take(take)})

        return run

    def go(rows: DataFrame, search: bool) -> DataFrame:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks("leaf")))
        return dealt.groupBy("leaf", "block").cogroup(spread.groupBy("leaf", "block")).applyInArrow(place(search), _PLACED)

    return go(inside, False), go(opened.where(is_large("leaf")).select("leaf", "id", "v"), True)
