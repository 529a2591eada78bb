import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.llm import mixing
from gridloom.llm.queries.corpus import p9_check

RIGHT = {"big": (True, True), "small": (True, True)}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """600 texts of two sources, a copy of the first text and one text of a source without a target."""
    d = str(tmp_path_factory.mktemp("mix"))
    rows = [(i, " ".join(f"{(i * 7919 + k * 31) % 9973}" for k in range(60)), ("big", " Small ")[i % 3 == 2]) for i in range(600)]
    rows += [(600, rows[0][1], "big"), (601, "of another source", "other")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("Big", 0.6, 1), ("small", 0.4, 2)], "source string, target_share double, max_repeats int").write.parquet(f"{d}/mix_targets.parquet")
    return d


@pytest.fixture
def told(spark, corpus, monkeypatch):
    """What p9_check says of a mix that is changed after it was made."""

    def run(change):
        plain = mixing.mix
        monkeypatch.setattr(mixing, "mix", lambda docs, targets: change(plain(docs, targets), docs))
        return {r.source: (r.near, r.within) for r in p9_check(spark, corpus).collect()}

    return run


def test_a_right_mix_passes(told):
    assert told(lambda m, docs: m) == RIGHT


@pytest.mark.parametrize("twice", [(0, 600), (1, 1)])
def test_a_text_by_two_copies_or_in_two_rows_is_used_too_often(told, twice):
    def change(m, docs):
        one = docs.select("doc_id", F.lit("big").alias("source"), "n_tokens", F.lit(1).cast("bigint").alias("repeats"))
        rest = m.where(~F.col("doc_id").isin(*twice))
        return rest.unionByName(one.where(F.col("doc_id") == twice[0])).unionByName(one.where(F.col("doc_id") == twice[1]))

    assert told(change) == RIGHT | {"big": (True, False)}


@pytest.mark.parametrize(("column", "other"), [("n_tokens", "n_tokens + 1"), ("doc_id", "-1L"), ("source", "if(source = 'big', 'small', 'big')")])
def test_a_row_that_the_documents_do_not_hold_is_not_within(told, column, other):
    def change(m, docs):
        first = F.col("doc_id") == F.min("doc_id").over(Window.partitionBy("source"))
        return m.withColumn("first", first).withColumn(column, F.when(F.col("first"), F.expr(other)).otherwise(F.col(column))).drop("first")

    assert told(change) == {"big": (True, False), "small": (True, False)}


def test_a_text_of_a_source_without_a_target_is_not_within(told):
    def change(m, docs):
        return m.unionByName(docs.where("doc_id = 601").select("doc_id", "source", "n_tokens", F.lit(1).cast("bigint").alias("repeats")))

    assert told(change) == {"big": (True, False), "small": (True, False)}


def test_a_mix_of_a_few_texts_is_not_near(told):
    assert told(lambda m, docs: m.where("doc_id < 12")) == {"big": (False, True), "small": (False, True)}


def test_an_empty_mix_is_not_near(told):
    assert told(lambda m, docs: m.limit(0)) == {"big": (False, True), "small": (False, True)}
