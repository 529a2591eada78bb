"""Queries on packing and mixing (p8, p9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions.keys import norm_key
from gridloom.llm import mixing, packing
from gridloom.llm.tokens import with_token_counts
from gridloom.session import Stage, merge_join, table


def p8_pack(spark, d):
    sizes = Stage(with_token_counts(table(spark, d, "documents"), ["doc_id"]), "tokens").df
    return packing.pack(sizes, table(spark, d, "pack_capacity"))


def p8_report(spark, d):
    return packing.fill_report(p8_pack(spark, d), table(spark, d, "pack_capacity"))


def p8_check(spark, d):
    """Per kind: texts placed, containers over their capacity, texts split that would fit, places taken twice, and whether the
    containers are at most a hundredth and one more than the least possible."""
    kinds = table(spark, d, "pack_capacity").select("container_kind", "capacity_tokens")
    packed = Stage(p8_pack(spark, d), "packed").df
    load = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("load"), (F.count("*") - F.countDistinct("place")).alias("twice"))
    texts = packed.groupBy("container_kind", "doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("size"))
    full = load.join(kinds, "container_kind").groupBy("container_kind").agg(
        F.count_if(F.col("load") > F.col("capacity_tokens")).alias("n_overfull"), F.sum("twice").alias("n_twice"),
        (F.count("*") <= 1 + 1.01 * F.ceil(F.sum("load") / F.first("capacity_tokens"))).alias("tight"),
    )
    whole = texts.join(kinds, "container_kind").groupBy("container_kind").agg(F.count("*").alias("n_texts"), F.count_if((F.col("parts") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("n_split"))
    return full.join(whole, "container_kind").select("container_kind", "n_texts", "n_overfull", "n_split", "n_twice", "tight")


def p9_check(spark, d):
    """Per target, against the documents: whether the share reached is within a hundredth and two blocks of the target, in a mix
    as large as the targets allow but for a hundredth and a block for each of them; and whether no text is used too often by all
    its rows and copies, nor stands there with another source or size than its own, nor any of a source without a target."""
    targets = table(spark, d, "mix_targets")
    sizes = Stage(_mix_sizes(spark, d), "sizes").df
    mixed = Stage(mixing.mix(sizes, targets), "mixed").df
    t = F.broadcast(targets.select(norm_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("target_share > 0"))

    texts = sizes.where("n_tokens > 0").withColumn("source", norm_key(F.col("source"))).join(t, "source", "left_semi")
    texts = texts.groupBy("text_hash").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("d.*")
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("have"))
    allowed = t.where("max_repeats > 0").join(have, "source")
    allowed = allowed.agg((F.min(F.col("have") * F.col("max_repeats") / F.col("target_share")) * F.sum("target_share")).alias("allowed"), F.count("*").alias("n"))

    held = sizes.select("doc_id", "text_hash", F.struct(norm_key(F.col("source")).alias("source"), "n_tokens").alias("held"))
    rows = merge_join(mixed, held, "doc_id", "left").withColumn("true", F.struct("source", "n_tokens").eqNullSafe(F.col("held")))
    used = rows.groupBy("text_hash").agg(F.sum("repeats").alias("uses"), F.min("true").alias("true"), F.collect_set("source").alias("sources"))
    used = used.select(F.explode("sources").alias("source"), "uses", "true").groupBy("source").agg(F.max("uses").alias("uses"), F.min("true").alias("true"))

    stray = mixed.join(t, "source", "left_anti").agg(F.count("*").alias("stray"))
    report = mixing.share_report(mixed, targets).withColumn("total", F.sum("tokens").over(Window.partitionBy()))
    near = F.abs(F.col("share_reached") - F.col("target_share")) <= 0.01 + F.try_divide(F.lit(2 * mixing.BLOCK_TOKENS), F.col("allowed"))
    whole = F.col("total") >= 0.99 * F.col("allowed") - (F.col("n") + 1) * mixing.BLOCK_TOKENS
    within = (F.col("stray") == 0) & (F.col("uses").isNull() | F.col("true") & (F.col("uses") <= F.col("max_repeats")))
    report = report.join(F.broadcast(used), "source", "left").crossJoin(F.broadcast(allowed)).crossJoin(F.broadcast(stray))
    return report.select("source", F.coalesce(near & whole, F.lit(False)).alias("near"), F.coalesce(within, F.lit(False)).alias("within"))


def _mix_sizes(spark, d):
    docs = table(spark, d, "documents").withColumn("text_hash", F.md5("text"))
    return with_token_counts(docs, ["doc_id", "source", "text_hash"])


def p9_mix(spark, d):
    return mixing.mix(_mix_sizes(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return mixing.share_report(p9_mix(spark, d), table(spark, d, "mix_targets"))


QUERIES = {"p8_pack": p8_pack, "p8_report": p8_report, "p8_check": p8_check, "p9_check": p9_check, "p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {
    "p8_check": "SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents) AS n_texts, 0 AS n_overfull, 0 AS n_split, 0 AS n_twice, true AS tight FROM pack_capacity",
    "p9_check": """SELECT DISTINCT lower(trim(source)) AS source, true AS near, true AS within FROM mix_targets""",
}
