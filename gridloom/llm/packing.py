"""Filling fixed-capacity containers with items.

Sizes are whole tokens no larger than the capacity, so an instance is its histogram of sizes: at most `capacity`
numbers, whatever the number of texts. The plan is made on that histogram. Martello-Toth dominance first fixes sets
that no other way of filling the container of their largest item can beat: an item nothing else fits beside, an item
with a partner that fills the container exactly, and an item with its largest partner when only one more item can
fit or when no two fitting items together outweigh that partner. The rest goes by best fit in order of falling size.
The plan is a list of slot runs: so many items of one size, so many to a container, from container b on. A text
finds its slot from its rank among the texts of its size.

A group of open containers is left by an item size at most log2(capacity) times (what remains is less than half),
and a size opens at most three groups, so a plan has at most 3 * 13 * capacity runs: its broadcast is bounded by the
capacity alone.

Defined results: a text longer than the capacity is cut into full parts and a rest, each an item; null and blank
texts have size 0 and share the containers evenly, placed after the others; equal sizes are ordered by doc_id, then
part; repeated doc_id are items each; an empty table gives no containers.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import Stage

Run = tuple[int, int, int, int, int]  # size, first rank, first container, items to a container, first place


class _Plan:
    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity, self.left = capacity, {s: n for s, n in counts.items() if n and s}
        self.sizes = sorted(self.left)
        self.used: dict[int, int] = defaultdict(int)
        self.runs: list[Run] = []
        self.containers = 0
        self.open: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # residual -> (first, n, items in each)
        self.residuals: list[int] = []

    def put(self, size: int, n: int, first: int, each: int, place: int) -> None:
        self.runs.append((size, self.used[size], first, each, place))
        self.used[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def fixed(self, parts: list[int], n: int) -> None:
        first, self.containers = self.containers, self.containers + n
        for place, size in enumerate(parts, 1):
            self.put(size, n, first, 1, place)
        self.opened(self.capacity - sum(parts), first, n, len(parts), closed=True)

    def opened(self, residual: int, first: int, n: int, items: int, closed: bool = False) -> None:
        if closed or not n or not residual:
            return
        if not self.open[residual]:
            bisect.insort(self.residuals, residual)
        self.open[residual].append((first, n, items))

    def best_partner(self, room: int, but: int) -> int | None:
        """The largest size left of at most room; but is the size already taken once."""
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0 and self.sizes[i] == but and self.left[but] < 2:
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def reduce(self) -> None:
        """Fix dominating sets, largest item first."""
        for j in sorted(self.sizes, reverse=True):
            while self.left.get(j):
                room = self.capacity - j
                k = self.best_partner(room, j)
                if k is None:
                    self.fixed([j], self.left[j])
                    continue
                many = self.left[j] // 2 if k == j else min(self.left[j], self.left[k])
                if k == room:
                    self.fixed([j, k], many)
                    continue
                low = self.sizes[0]
                second = low if self.left[low] > 1 + (low == j) else next((s for s in self.sizes[1:2]), low)
                # what is fixed only takes items away: the smallest ones left grow and the best two shrink, so a
                # condition that holds once holds as long as there are j and k
                if low + second > room or self.best_two(room, j) <= k and 3 * low > room:
                    self.fixed([j, k], many)
                    continue
                break

    def best_two(self, room: int, j: int) -> int:
        """The greatest sum of two items left (beside one j) that is at most room."""
        best, hi = 0, bisect.bisect_right(self.sizes, room) - 1
        lo = 0
        while lo <= hi:
            s = self.sizes[lo] + self.sizes[hi]
            if s > room or lo == hi and self.left[self.sizes[lo]] < 2 + (self.sizes[lo] == j):
                hi -= 1
            else:
                best, lo = max(best, s), lo + 1
        return best

    def best_fit(self) -> None:
        for size in sorted(self.sizes, reverse=True):
            while n := self.left.get(size, 0):
                i = bisect.bisect_left(self.residuals, size)
                if i < len(self.residuals):
                    room = self.residuals[i]
                    first, have, items = self.open[room].pop()
                    if not self.open[room]:
                        self.residuals.pop(i)
                else:
                    room, first, items = self.capacity, self.containers, 0
                    have = -(-n // (room // size))
                    self.containers += have
                each = room // size
                full = min(have, n // each)
                if full:
                    self.put(size, full * each, first, each, items + 1)
                    self.opened(room - each * size, first, full, items + each)
                rest = self.left.get(size, 0) if full < have else 0
                if full < have and 0 < rest < each:
                    self.put(size, rest, first + full, rest, items + 1)
                    self.opened(room - rest * size, first + full, 1, items + rest)
                    full += 1
                self.opened(room, first + full, have - full, items)


def plan_containers(capacity: int, counts: dict[int, int]) -> tuple[int, list[Run]]:
    """The number of containers and the slot runs that hold counts[size] items of every size up to capacity."""
    p = _Plan(capacity, counts)
    p.reduce()
    p.best_fit()
    if blank := counts.get(0):
        p.containers = max(1, p.containers)
        p.runs.append((0, 0, 0, -(-blank // p.containers), capacity + 1))
    return p.containers, p.runs


def _items(sizes: DataFrame, caps: dict[str, int], salts: int) -> DataFrame:
    """(container_kind, doc_id, part, size, salt) of whole texts and of the parts of longer ones."""
    cap, n = F.col("capacity_tokens"), F.col("n_tokens")
    parts = F.greatest(F.ceil(n / cap).cast("bigint"), F.lit(1))
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity_tokens")) for k, c in caps.items()])
    return (
        sizes.select("doc_id", "n_tokens", F.inline(kinds))
        .withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), parts)))
        .select("container_kind", "doc_id", "part", F.least(cap.cast("bigint"), n - (F.col("part") - 1) * cap).alias("size"), F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int").alias("salt"))
    )


#: Kinds of containers are a parameter of the operator, not data.
MAX_KINDS = 100


def pack(sizes: DataFrame, kinds: DataFrame, salts: int | None = None) -> DataFrame:
    """(container_kind, container_id, place, doc_id, part, n_tokens) of sizes(doc_id, n_tokens) for every kind.

    Ranks are taken per (kind, size, salt) and shifted by the counts of the salts before, so a size that a third of
    all texts share is still numbered by many tasks.
    """
    spark = sizes.sparkSession
    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    caps = {r[0]: int(r[1]) for r in kinds.select("container_kind", "capacity_tokens").where("capacity_tokens > 0").limit(MAX_KINDS + 1).collect()}
    assert len(caps) <= MAX_KINDS
    items = _items(sizes, caps, salts)
    key = ["container_kind", "size"]
    counts = Stage(items.groupBy(*key, "salt").agg(F.count("*").alias("n")), "sizes").df
    plans, index = {}, {}
    histogram: dict[str, dict[int, int]] = {k: {} for k in caps}
    for k, s, n in counts.groupBy(*key).agg(F.sum("n")).collect():  # at most the sum of the capacities
        histogram[k][s] = n
    for k, cap in caps.items():
        _, runs = plan_containers(cap, histogram[k])
        r = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
        plans[k] = r
        index[k] = (r[:, 0] << 48) + r[:, 1]
    sent = spark.sparkContext.broadcast((plans, index))

    before = Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy(*key, "salt").orderBy("doc_id", "part")
    ranked = items.withColumn("rank", F.row_number().over(within) - 1).join(offsets, [*key, "salt"]).withColumn("rank", F.col("rank") + F.col("shift"))

    @F.pandas_udf("container_id bigint, place bigint")
    def slot(kind: pd.Series, size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        plans, index = sent.value
        out = np.zeros((len(kind), 2), np.int64)
        for k in kind.unique():
            rows = np.flatnonzero((kind == k).to_numpy())
            s, r = size.to_numpy()[rows].astype(np.int64), rank.to_numpy()[rows].astype(np.int64)
            p = plans[k][np.searchsorted(index[k], (s << 48) + r, "right") - 1]
            out[rows, 0] = p[:, 2] + (r - p[:, 1]) // p[:, 3]
            out[rows, 1] = p[:, 4] + (r - p[:, 1]) % p[:, 3]
        return pd.DataFrame({"container_id": out[:, 0], "place": out[:, 1]})

    return ranked.withColumn("slot", slot("container_kind", "size", "rank")).select(
        "container_kind", F.col("slot.container_id").alias("container_id"), F.col("slot.place").alias("place"), "doc_id", "part", F.col("size").alias("n_tokens")
    )


def fill_report(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Containers, tokens, share filled and the least possible number of containers per kind."""
    each = packed.groupBy("container_kind").agg(
        (F.max("container_id") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("items")
    )
    cap = F.col("capacity_tokens")
    return each.join(F.broadcast(kinds.select("container_kind", "capacity_tokens").limit(MAX_KINDS)), "container_kind").select(
        "container_kind", "containers", "items", "tokens", F.ceil(F.col("tokens") / cap).cast("bigint").alias("least_containers"), (F.col("tokens") / (F.col("containers") * cap)).alias("filled")
    )
