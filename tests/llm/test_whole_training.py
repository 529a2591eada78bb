"""Models learn from every row, however many there are."""

import numpy as np
import pandas as pd
import pytest

from gridloom.llm.boosting import Boosted
from gridloom.llm.scans import Letters, _broken_samples, _misread_samples, _nearest
from gridloom.session import Scratch


@pytest.mark.parametrize("here", [1_000_000, 10])
def test_trees_of_a_table_are_those_of_all_its_rows(spark, here):
    """Also where only sums come to the driver, and with rows that count several times."""
    rng = np.random.default_rng(3)
    x = np.round(rng.random((600, 3)), 1)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    times = rng.integers(1, 4, 600)
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y, "times": times}))
    whole = Boosted(rounds=11, depth=2).fit(np.repeat(x, times, axis=0), np.repeat(y, times))
    got = Boosted(rounds=11, depth=2).fit_rows(rows, ["a", "b", "c"], weight="times", here=here)
    assert np.abs(got.predict(x) - whole.predict(x)).max() < 1e-9


def test_tables_without_rows_or_with_one_class(spark):
    rows = spark.createDataFrame([(0.1, 1.0), (0.7, 1.0)], "a double, label double")
    assert (Boosted().fit_rows(rows, ["a"]).predict(np.zeros((1, 1))) > 0.9).all()
    assert Boosted().fit_rows(rows.limit(0), ["a"]).predict(np.zeros((1, 1))) == 0.5


def _words(n):
    """Different words of seven letters."""
    return ["W" + "".join(chr(97 + i // 26**k % 26) for k in range(5)) + "s" for i in range(n)]


def test_every_known_word_is_broken(spark):
    types = spark.createDataFrame([(w, 2) for w in _words(20_500)], "token string, docs long")
    assert _broken_samples(types).count() == 20_500


def test_every_known_number_is_misread(spark):
    totals = spark.createDataFrame([(str(10_000 + i), 2) for i in range(3_000)], "token string, docs long")
    shapes = spark.createDataFrame([("99999", 6000)], "shape string, docs long")
    made = _misread_samples(totals, shapes)
    made = made if isinstance(made, list) else [tuple(r) for r in made.collect()]
    assert len({truth for _, truth in made}) > 2_900  # some have no digit of the table or share a misreading


def test_the_nearest_word_comes_after_hundreds_that_share_a_gram(spark):
    words = [f"Mar{w[1:]}" for w in _words(400)] + ["Marzqxvuk", "Marzqxvuj"]
    table = spark.createDataFrame(list(enumerate(words)), "id long, token string")
    with Scratch() as scratch:
        near = {(r.id, r.near) for r in _nearest(table, scratch).collect()}
    assert (400, 401) in near and (401, 400) in near
    assert all(sum(a == i for a, _ in near) == 3 for i in range(0, 402, 40))


def test_letters_count_every_word(spark):
    words = _words(9_000)
    letters = Letters.of(spark.createDataFrame([(w,) for w in words], "token string"))
    assert sum(letters.three.values()) == sum(len(w) + 1 for w in words) and sum(letters.two.values()) == sum(letters.three.values())
