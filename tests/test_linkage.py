import random

from pyspark.sql import functions as F

from gridloom.functions.similarity import jaro_winkler, jaro_winkler_levels
from gridloom.operators import resolve


def test_blocks_without_a_likely_pattern_are_not_compared_again(spark, monkeypatch):
    """The second pass reads only the blocks in which the first one counted a pattern above the threshold."""
    rng = random.Random(9)
    data = [(f"n{k:03}", "p", "".join(rng.choices("abcdefghiklmnoprstuv", k=9))) for k in range(60)]
    data += [(f"o{k}", "p", data[k // 2][2] * 2) for k in range(10)]
    df = spark.createDataFrame(data, "node_id string, type string, name string")
    written = {}
    whole = resolve.Stage.__init__
    monkeypatch.setattr(resolve.Stage, "__init__", lambda self, d, label="stage", *a: (whole(self, d, label, *a), written.__setitem__(label, self.df))[0])
    got = {(r.l_id, r.r_id) for r in resolve.linked_by_type(df, {"name": (0.7, 0.9)}, (), F.col("type"), 0.8, rows=10).collect()}
    expected = resolve.probabilistic_pairs(df, {"name": (0.7, 0.9)}, (), [[F.col("type")]], 0.8)
    assert got == {(r.l_id, r.r_id) for r in expected.collect()}
    assert written["tally"].select("kind", "i", "j").distinct().count() == 28 and written["tally"].agg(F.sum("n")).first()[0] == 70 * 69 // 2


def test_jaro_winkler_levels_of_unlike_strings():
    rng = random.Random(12)
    draw = lambda n: ["".join(rng.choices("abcdefgh é1", k=rng.randrange(0, 40))) for _ in range(n)] + ["a" * 70, "x\0y"]
    a, b = draw(60), draw(80)
    for cuts in ([0.7, 0.9], [0.55], [0.95]):
        assert jaro_winkler_levels(a, b, cuts).tolist() == [[sum(jaro_winkler(x, y) >= c for c in cuts) if x and y else 0 for y in b] for x in a]
