"""Gradient-boosted trees for two classes, small enough to send to every task, trained on every row of a table.

Trees see rows by the bins of their features only, so rows of equal bins are gathered with their number first. Up to HERE of
those are trained on the driver; of more, each level of each tree is one sum over the table. Both give the same trees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import Scratch

#: Rows of different bins up to which a table is trained on the driver.
HERE = 200_000
#: Trees after which the scores of a larger table are written.
KEPT = 10


def _at(tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
    """The node each row ends at."""
    feature = np.array([t[0] for t in tree])
    cut = np.array([t[1] for t in tree])
    at = np.zeros(len(x), np.int64)
    while len(i := np.flatnonzero(feature[at] >= 0)):
        at[i] = 2 * at[i] + 1 + (x[i, feature[at[i]]] > cut[at[i]])
    return at


def _one(tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
    return np.array([t[2] for t in tree])[_at(tree, x)]


def _sums(binned: np.ndarray, gradients: np.ndarray, at: np.ndarray, first: int, features: int, size: int) -> np.ndarray:
    """(node, feature, bin, gradient | hessian | rows): sums over the rows at the nodes first to 2 * first."""
    here = np.flatnonzero(at >= first)
    out = np.zeros((first + 1, features, size, 3))
    weights = gradients[:, here]
    slot = (at[here] - first) * size
    for f in range(features):
        place = slot + binned[here, f]
        for k in range(3):
            out[:, f, :, k] = np.bincount(place, weights=weights[k], minlength=(first + 1) * size).reshape(first + 1, size)
    return out


def _gradients(score: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    prob = 1 / (1 + np.exp(-score))
    return np.stack([n * (y - prob), n * np.maximum(prob * (1 - prob), 1e-6), n])


class _Here:
    """Binned rows in memory."""

    def __init__(self, binned: np.ndarray, y: np.ndarray, n: np.ndarray, base: float):
        self.binned, self.y, self.n, self.score = np.asfortranarray(binned), y, n, np.full(len(y), base)
        self.gradients = _gradients(self.score, y, n)

    def sums(self, tree: list, first: int, features: int, size: int) -> np.ndarray:
        return _sums(self.binned, self.gradients, _at(tree, self.binned), first, features, size)

    def add(self, tree: list) -> None:
        self.score += _one(tree, self.binned)
        self.gradients = _gradients(self.score, self.y, self.n)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bins, labels and numbers of rows (bins, y, n)."""
    keys = batch["bins"].to_pylist()
    binned = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1).astype(np.int64)
    return binned, batch["y"].to_numpy(), batch["n"].to_numpy()


class _There:
    """Binned rows (bins, y, n) of a table; only sums come to the driver."""

    def __init__(self, table: DataFrame, base: float, scratch: Scratch):
        self.table, self.scratch, self.new = table.withColumn("score", F.lit(base)), scratch, []

    def sums(self, tree: list, first: int, features: int, size: int) -> np.ndarray:
        new = self.new

        def run(batches):
            total = np.zeros((first + 1, features, size, 3))
            for batch in batches:
                binned, y, n = _unpacked(batch)
                score = sum((_one(t, binned) for t in new), batch["score"].to_numpy())
                total += _sums(binned, _gradients(score, y, n), _at(tree, binned), first, features, size)
            flat = total.reshape(-1, 3)
            slot = np.flatnonzero(flat[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), *[pa.array(flat[slot, k]) for k in range(3)]], ["slot", "g", "h", "n"])

        out = np.zeros(((first + 1) * features * size, 3))
        for slot, *values in self.table.mapInArrow(run, "slot long, g double, h double, n double").groupBy("slot").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect():
            out[slot] = values
        return out.reshape(first + 1, features, size, 3)

    def add(self, tree: list) -> None:
        self.new = [*self.new, tree]
        if len(self.new) < KEPT:
            return
        new = self.new

        def run(batches):
            for batch in batches:
                score = sum((_one(t, _unpacked(batch)[0]) for t in new), batch["score"].to_numpy())
                yield pa.RecordBatch.from_arrays([batch["bins"], batch["y"], batch["n"], pa.array(score)], ["bins", "y", "n", "score"])

        self.table, self.new = self.scratch.stage(self.table.mapInArrow(run, "bins binary, y double, n double, score double"), "scores"), []


class Boosted:
    """Logistic boosting of depth-limited regression trees on quantile bins; no randomness."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base = 0.0
        self.trees: list[list[tuple[int, float, float]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        if not self._start(len(y), float(y.sum())):
            return self
        cuts = [np.unique(np.quantile(c, self._quantiles())) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        return self._grow(_Here(binned, y, np.ones(len(y)), self.base), cuts)

    def fit_rows(self, rows: DataFrame, features: list[str], label: str = "label", weight: str | None = None, here: int = HERE) -> Boosted:
        """Trained on every row of a table; weight, a whole number, says how often a row counts."""
        n = F.col(weight) if weight else F.lit(1)
        rows = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("y"), n.cast("bigint").alias("n"))
        count, ones, *cuts = rows.agg(F.sum("n"), F.sum(F.col("y") * F.col("n")), *[F.percentile(c, self._quantiles().tolist(), F.col("n")) for c in features]).first()
        if not self._start(count or 0, ones or 0.0):
            return self
        cuts = [np.unique(c) for c in cuts]

        def binned(batches):
            for batch in batches:
                keys = np.stack([np.searchsorted(c, batch[i].to_numpy(zero_copy_only=False), "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), batch["y"], batch["n"]], ["bins", "y", "n"])

        with Scratch() as scratch:
            table = scratch.stage(rows.mapInArrow(binned, "bins binary, y double, n bigint").groupBy("bins", "y").agg(F.sum("n").cast("double").alias("n")), "binned")
            if table.count() > here:
                return self._grow(_There(table, self.base, scratch), cuts)
            return self._grow(_Here(*_unpacked(table.toArrow().sort_by([("bins", "ascending"), ("y", "ascending")])), self.base), cuts)

    def _quantiles(self) -> np.ndarray:
        return np.linspace(0, 1, self.bins + 1)[1:-1]

    def _start(self, count: int, ones: float) -> bool:
        """Sets the score without trees; whether there are two classes to tell apart."""
        p = float(np.clip(ones / count, 1e-3, 1 - 1e-3)) if count else 0.5
        self.base = float(np.log(p / (1 - p)))
        return 0 < ones < count

    def _grow(self, rows: _Here | _There, cuts: list[np.ndarray]) -> Boosted:
        size = max(len(c) for c in cuts) + 1
        for _ in range(self.rounds):
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            first, more = 0, True
            while more:
                more, last = False, 2 * first + 1 >= len(tree)
                sums = rows.sums(tree, first, 1 if last else len(cuts), size)
                for node in range(first, 2 * first + 1):
                    g, h, n = sums[node - first, 0].sum(axis=0)
                    if not n:
                        continue
                    tree[node] = (-1, 0.0, self.rate * g / (h + 1.0))
                    if last or n < 2 * self.least or size == 1:
                        continue
                    gs, hs, ns = np.moveaxis(sums[node - first].cumsum(axis=1)[:, :-1], 2, 0)
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    gain[(ns < self.least) | (n - ns < self.least)] = -1
                    f, k = divmod(int(gain.argmax()), size - 1)
                    if gain[f, k] > 1e-6:
                        tree[node], more = (f, k, tree[node][2]), True
                first = 2 * first + 1
            rows.add(tree)
            self.trees.append([(f, float(cuts[f][k]) if f >= 0 else 0.0, v) for f, k, v in tree])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += _one(tree, x)
        return 1 / (1 + np.exp(-score))
