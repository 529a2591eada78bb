import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm.repetition import band, expected_ratio, fit_expected, repeated_shares, repetition, repetitive_documents

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}" for i in range(4000)]
SENTENCE = " ".join(WORDS[:20])


def brute(text, k=5, gap=2, least=12):
    words = [w.strip(".,;:!?") for w in text.lower().split()]
    seen, covered = set(), [False] * len(words)
    for i in range(len(words) - k + 1):
        g = tuple(words[i : i + k])
        if g in seen:
            covered[i : i + k] = [True] * k
        seen.add(g)
    i = 0
    while i < len(words):
        j = i
        while j < len(words) and covered[j] == covered[i]:
            j += 1
        if not covered[i] and i > 0 and j < len(words) and j - i <= gap:
            covered[i:j] = [True] * (j - i)
            i = 0
            continue
        i = j
    i, total = 0, 0
    while i < len(words):
        j = i
        while j < len(words) and covered[j] == covered[i]:
            j += 1
        if covered[i] and j - i >= least:
            total += sum(len(w) + 1 for w in text.lower().split()[i:j])
        i = j
    return total / max(1, sum(len(w) + 1 for w in text.split()))


TEXTS = [
    "", "   ", "one", " ".join(WORDS[:300]), f"{SENTENCE}. {SENTENCE.upper()};  {SENTENCE} .", "spam " * 200, " ".join(WORDS[:100]) + " " + " ".join(WORDS[:50]) + " changed " + " ".join(WORDS[51:100]),
    " ".join([*WORDS[:8], *WORDS[100:110], *WORDS[:8], *WORDS[200:210], *WORDS[:8]]), "x" * 5000,
]


def test_shares_against_brute_force():
    got = repeated_shares(pa.array(TEXTS, pa.string()))
    assert got == pytest.approx([brute(t) for t in TEXTS])


def test_documents_and_edges(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, None, "x"), (4, TEXTS[4], "x"), (101, " ".join(WORDS) * 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, band string")
    out = repetition(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[100].band == by[0].band == by[1].band == "empty" and by[100].repeated_share == 0
    found = sorted(r.doc_id for r in repetitive_documents(df).collect())
    assert found == [4, 4, 5, 6, 101]
    assert repetition(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_depend_on_length():
    assert band(0, 0, 0) == "empty" and band(200, 1.2, 1.2) == "plain" and band(900, 1.7, 1.7) == "plain" and band(900, 2.2, 2.2) == "borderline" and band(900, 4.0, 4.0) == "repetitive"
    assert band(9000, 2.0, 9.0) == "borderline" and band(5000, 1.0, 1.0) == "incompressible" and band(100_000, 9, 9) == "long"
    assert band(5000, 99.0, 99.0, words=1) == "plain"


def test_bands_against_the_exact_share(spark, sf):
    """No repetitive text below the borderline band, none that is not in the repetitive one, and the curve is that of the texts without repeats."""
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    every = repetition(docs).join(docs.select("doc_id", F.octet_length("text").alias("n")), "doc_id").where("n > 0 and ratio > 0").toPandas()
    assert not ((every.repeated_share >= 0.35) & ~every.band.isin(["repetitive", "borderline"])).any()
    assert (every[every.band == "repetitive"].repeated_share >= 0.35).all() and (every.band == "repetitive").sum() > 10
    plain = every[every.repeated_share < 0.02]
    a, b, c = fit_expected(plain.n.to_numpy(), plain.ratio.to_numpy())
    for n in (300, 1000, 4000, 20_000):
        x = math.log(n)
        assert abs(a * x * x + b * x + c - expected_ratio(n)) < 0.06 * expected_ratio(n)


def prose(words, seed):
    """Words in random order, of a vocabulary that compresses like prose."""
    rng = random.Random(seed)
    return " ".join(rng.choices(WORDS, k=words))


def test_repeats_beyond_the_compressors_window_are_found(spark):
    """A text of 4 MB written twice, one of 0.2 MB written twice with every tenth word changed, and a long one without repeats."""
    once = prose(520_000, 1)
    near = prose(30_000, 2).split(" ")
    changed = [f"{w}x{i}" if i % 10 == 0 else w for i, w in enumerate(near)]
    rows = [(0, f"{once} {once}"), (1, once), (2, " ".join(near + changed))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(once) > 4_000_000 and sorted(r.doc_id for r in repetitive_documents(df).collect()) == [0, 2]
