"""Mixing sources to target weights.

The mix is a number of equal-token blocks. Sainte-Lague gives them to sources: the next block always goes to the
source with the highest quotient share / (2 * seats + 1) among those that still have a block to give, their tokens
times max_repeats bounding what they give. The same rule divides a source's quota over its shards by their tokens.
Inside a shard the texts stand in a seeded order, cut into blocks at running token sums; as many blocks as the quota
are taken, first whole passes over the shard and then its first blocks once more.

Without a wanted total the mix is as large as the targets allow: the total at which the scarcest source is used up.

Defined results: sources compare without case and outer blanks; texts of a null or untargeted source, and texts
without tokens, are not used; of equal texts only the one of smallest doc_id counts, so no text is used more than
max_repeats times; a target without texts gets nothing and does not bound the others; shares need not sum to 1.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.keys import norm_key
from gridloom.session import Stage

BLOCK_TOKENS = 4096
SHARD_DOCS = 50_000
MAX_SHARDS = 4096
MAX_TARGETS = 100


def sainte_lague(weights: dict, seats: int, caps: dict) -> dict:
    """Seats per key by highest quotient weight / (2n + 1); none beyond its cap. Ties go to the smaller key."""
    keys = sorted(k for k, w in weights.items() if w > 0 and caps.get(k, 0) > 0)
    seats = min(seats, sum(caps[k] for k in keys))
    won = lambda level: {k: min(caps[k], max(0, math.floor(weights[k] / level / 2 + 0.5))) for k in keys}
    if not keys or seats <= 0:
        return {}
    low, high = min(weights[k] / (2 * caps[k] + 2) for k in keys) / 2, max(weights.values()) * 2
    for _ in range(200):  # the level of quotient at which just too few seats are given
        mid = math.sqrt(low * high)
        low, high = (mid, high) if sum(won(mid).values()) > seats else (low, mid)
    given = won(high)
    queue = [(-weights[k] / (2 * given[k] + 1), k) for k in keys if given[k] < caps[k]]
    heapq.heapify(queue)
    for _ in range(seats - sum(given.values())):
        _, k = heapq.heappop(queue)
        given[k] += 1
        if given[k] < caps[k]:
            heapq.heappush(queue, (-weights[k] / (2 * given[k] + 1), k))
    return given


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of docs(doc_id, source, text_hash, n_tokens) for the texts chosen.

    The driver sees one number per source and shard only: at most MAX_SHARDS for each target.
    """
    spark = docs.sparkSession
    rows = targets.select(norm_key(F.col("source")), F.col("target_share").cast("double"), F.col("max_repeats").cast("bigint")).limit(MAX_TARGETS + 1).collect()
    assert len(rows) <= MAX_TARGETS
    share = {s: w for s, w, _ in rows if s and w and w > 0}
    repeats = {s: max(0, r or 0) for s, _, r in rows}

    known = docs.where("n_tokens > 0").withColumn("source", norm_key(F.col("source"))).where(F.col("source").isin(*share))
    one = known.groupBy("text_hash").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("d.*")
    one = Stage(one, "texts").df
    shards = min(MAX_SHARDS, max(1, one.count() // SHARD_DOCS))
    place = one.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("shard", F.pmod("h", F.lit(shards)))
    tokens = {(s, i): n for s, i, n in place.groupBy("source", "shard").agg(F.sum("n_tokens")).collect()}

    have: dict[str, int] = {}
    for (s, _), n in tokens.items():
        have[s] = have.get(s, 0) + n
    if total_tokens is None:
        total_tokens = min((have[s] * repeats[s] / share[s] for s in have if repeats[s]), default=0) * sum(share[s] for s in have)
    quota = sainte_lague(share, int(total_tokens / block_tokens), {s: n * repeats[s] // block_tokens for s, n in have.items()})
    plan = []
    for s, q in quota.items():
        own = {i: n for (x, i), n in tokens.items() if x == s}
        for i, blocks in sainte_lague(own, q, {i: -(-n * repeats[s] // block_tokens) for i, n in own.items()}).items():
            wanted = min(blocks * block_tokens, own[i] * repeats[s])
            plan.append((s, i, wanted // own[i], wanted % own[i]))
    quotas = spark.createDataFrame(plan or [], "source string, shard bigint, passes bigint, rest bigint")

    w = Window.partitionBy("source", "shard").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.sum("n_tokens").over(w) - F.col("n_tokens") / 2
    return (
        place.withColumn("middle", middle)
        .join(F.broadcast(quotas), ["source", "shard"])
        .withColumn("repeats", F.col("passes") + (F.col("middle") < F.col("rest")).cast("bigint"))
        .where("repeats > 0")
        .select("doc_id", "source", "n_tokens", "repeats")
    )


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, tokens used, the share reached, texts and the greatest number of uses; an empty mix
    reaches no share (null)."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("texts"), F.max("repeats").alias("most_repeats"))
    t = targets.select(norm_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    out = t.join(used, "source", "left").na.fill(0, ["tokens", "texts", "most_repeats"])
    return out.withColumn("share_reached", F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())))
