from pyspark.sql import functions as F

from gridloom.operators.evaluate import recognise


def test_windows_of_no_alias_are_not_written(spark):
    """Only windows that may be an alias go to the join with the index."""
    texts = spark.range(200).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("id") * 311).cast("string")))).alias("text"))
    texts = texts.unionByName(spark.createDataFrame([(1000, "Meet ACME Steel Works, and acme!"), (1001, None), (1002, ""), (None, "acme")], "id long, text string"))
    index = spark.createDataFrame([("acme", "A"), ("acme steel works", "S"), ("one two three four five six seven eight nine ten eleven", "L")], "alias string, entity string")
    out = recognise(texts, index)
    assert {r.id: r.entities for r in out.where("size(entities) > 0").collect()} == {1000: ["S", "A"]}
    assert out.count() == 204 and not recognise(texts, index.limit(0)).where("size(entities) > 0").count()
    plan = recognise(texts, index)._jdf.queryExecution()
    plan.toRdd().count()
    written = [int(m) for m in _metrics(plan.executedPlan())]
    assert written and max(written) < 1_000  # of 60,000 words, 180,000 windows


def _metrics(plan):
    """Rows that each exchange but those of the ids wrote."""
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    plan = plan.plan() if plan.nodeName().endswith("QueryStage") else plan
    if plan.nodeName() == "Exchange":
        yield plan.metrics().get("shuffleRecordsWritten").get().value()
    for k in range(plan.children().size()):
        yield from _metrics(plan.children().apply(k))
