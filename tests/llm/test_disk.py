"""What a job leaves on disk while it runs."""

import random
from collections import Counter

from pyspark.sql import functions as F

from gridloom.llm.scans import _nearest
from gridloom.session import Scratch, Stage


def shuffled(spark):
    """Shuffles whose files are still kept."""
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    stages = [Stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()) for _ in range(3)]
    assert shuffled(spark) <= before
    assert all(s.df.count() == 7 for s in stages)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_nearest_words_in_blocks(spark):
    rnd = random.Random(3)
    tokens = sorted({"".join(rnd.choice(["ka", "Lo", "mi", "ru", "te"]) for _ in range(rnd.randrange(1, 6))) for _ in range(90)} | {"a", "ab"})
    words = spark.createDataFrame([(t,) for t in tokens], "token string").withColumn("id", F.xxhash64("token"))
    rows = {r.id: (r.token, r.tie) for r in words.withColumn("tie", F.xxhash64("id")).collect()}

    def grams(token):
        w = f"^{token.lower()}$"
        return {(w[i : i + 3], i) for i in range(max(len(w) - 2, 1))} if len(token) >= 2 else set()

    want = set()
    for x, (token, _) in rows.items():
        met = Counter({y: len(grams(token) & grams(other)) for y, (other, _) in rows.items() if y != x})
        want |= {(x, y) for y, n in sorted(met.items(), key=lambda p: (-p[1], rows[p[0]][1], p[0]))[:3] if n}
    with Scratch() as scratch:
        for size in (7, 1000):
            assert {(r.id, r.near) for r in _nearest(words, scratch, size).collect()} == want
