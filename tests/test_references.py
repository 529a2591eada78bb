import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.operators.references import Parent, Reference, compress_runs, dangling_references, dangling_report

PARENT = "pk string, created_at timestamp, deleted_at timestamp, n int, live string"
REF = "load_seq long, fk string, created_at timestamp, n int, ik string"
T0 = datetime(2024, 1, 1)


def brute(parents, refs):
    by = {}
    for k, c, d, *_ in parents:
        if k and k.strip():
            f, live = by.get(k.strip().lower(), (None, False))
            f = c if f is None or (c is not None and c < f) else f
            by[k.strip().lower()] = (f, live or d is None)
    out = set()
    for i, k, c, *_ in refs:
        if not k or not k.strip():
            continue
        hit = by.get(k.strip().lower())
        if hit is None:
            out.add((i, "missing"))
        elif not hit[1]:
            out.add((i, "deleted"))
        elif c and hit[0] and c < hit[0]:
            out.add((i, "late"))
    return out


def found(spark, parents, refs):
    p = Parent("p", spark.createDataFrame(parents, PARENT), "pk")
    r = Reference("r", spark.createDataFrame(refs, REF), {"fk": "p"})
    return {(x.load_seq, x.reason) for x in dangling_references([p], [r]).collect()}


def test_against_brute_force_with_runs_and_a_hot_key(spark):
    rnd = random.Random(1)
    key = lambda i: f"{i:016x}"
    parents = [(rnd.choice([key(i), key(i).upper(), f" {key(i)} "]), T0 + timedelta(days=rnd.randrange(20)), rnd.choice([None, None, T0]), 1, "x") for i in [*range(40), *range(2**64 - 20, 2**64), *range(100, 160, 3)] for _ in range(rnd.randrange(1, 3))]
    parents += [("other key", T0, None, 1, "x"), (None, T0, None, 1, "x"), ("", T0, None, 1, "x")]
    refs = [(i, rnd.choice([key(rnd.randrange(170)), key(2**64 - 1 - rnd.randrange(30)), "OTHER KEY ", "nope", None, "  ", key(5)]), rnd.choice([T0 + timedelta(days=rnd.randrange(25)), None]), 1, "x") for i in range(600)]
    assert found(spark, parents, refs) == brute(parents, refs)


def test_empty_sides_and_repeats(spark):
    refs = [(1, "a", T0, 1, "x"), (1, "a", T0, 1, "x"), (2, None, T0, 1, "x")]
    assert found(spark, [], refs) == {(1, "missing")}
    assert found(spark, [("a", T0, None, 1, "x")], []) == set()
    p = Parent("p", spark.createDataFrame([], PARENT), "pk")
    rows = dangling_references([p], [Reference("r", spark.createDataFrame(refs, REF), {"fk": "p"})])
    assert rows.count() == 2  # repeated rows are reported each
    assert [tuple(r) for r in dangling_report(rows).collect()] == [("r", "fk", "2024-01", "missing", 2)]


def test_runs_are_compressed(spark):
    df = spark.createDataFrame([(i, T0) for i in [1, 2, 3, 7, 9, 10]], "ik long, first_created timestamp").withColumn("g", F.lit(0))
    assert sorted((r.start, r.stop) for r in compress_runs(df, ["g"]).collect()) == [(1, 3), (7, 7), (9, 10)]


def test_hot_keys_never_enter_the_shuffle(spark, monkeypatch):
    """A key of a third of all rows with a partner and one without: same rows as a plain join, and neither is shuffled."""
    from gridloom import session

    monkeypatch.setattr(session, "HOT_LEAST", 50)
    big = spark.range(3000).select((F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "lost").otherwise(F.concat(F.lit("k"), F.col("id") % 400))).alias("k"), "id", F.lit(1).alias("n"))
    lookup = spark.createDataFrame([("hot", "a"), *[(f"k{i}", "b") for i in range(0, 400, 2)]], "k string, v string")
    counts = big.groupBy("k").agg(F.count("*").alias("rows"))
    got = session.skew_join(big, lookup, counts, ["k"], "rows")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(lookup, "k").collect()))
    cold = session.skew_join(big, lookup, counts, ["k"], "rows")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in cold


def test_a_cluster_must_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from gridloom.session import shared_dir

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake)
