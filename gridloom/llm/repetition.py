"""Repetition inside a single document.

zstandard ratios over the whole text and over fixed chunks of it, set against the ratio that prose of that length has, put
every document in a band. Text of which a share s is said again compresses about 1 / (1 - s) times as well, so the bands
lie on both sides of the 1.54 of a share of 0.35: from CERTAIN times the expected ratio on a text is "repetitive" by
its ratio alone, below DOUBTFUL (for chunks CHUNK_DOUBTFUL) it is "plain" or "incompressible", and between them it is
"borderline". Texts of more than LONG bytes, of which the compressor no longer remembers every place, are band "long" whatever
their ratio. Borderline and long documents are then measured exactly:
the share of their characters in words that repeat, word for word or nearly so, what stands earlier in the text.
A repeat is a run of at least MIN_RUN words covered by five-word shingles seen before, across gaps of up to GAP
changed words, so set phrases do not count, and a text of fewer words has no band above "plain". Words compare in lower
case, without white space and outer punctuation.

Defined results: null and blank texts have share 0 and band "empty"; a very long text is one document and
always measured; repeated doc_id are measured each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, GAP, MIN_RUN = 5, 2, 12
CHUNK = 4096
#: As many places as zstandard's smaller table holds at level 3; its window ends at 2 MB.
LONG = 1 << 16
#: The ratio of prose that repeats nothing, as a parabola in the logarithm of its bytes, fitted by `fit_expected`.
EXPECTED = (0.0279, -0.0395, 0.6966)
DOUBTFUL, CERTAIN, CHUNK_DOUBTFUL = 1.05, 1.8, 1.3
INCOMPRESSIBLE = 0.6
#: The bands whose documents are measured.
MEASURED = ("borderline", "long")
_PUNCTUATION = ".,;:!?\"'()[]{}<>|।–—-…“”‘’*/\\"


def _runs(mask: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    new = np.ones(len(mask), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    return np.cumsum(new) - 1, start, np.diff(np.append(start, len(mask)))


def repeated_shares(texts: pa.Array) -> np.ndarray:
    """The share of repeated characters of each text, over all texts of a batch at once."""
    count = len(texts)
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    offsets = words.offsets.to_numpy()
    flat = words.values.slice(offsets[0], offsets[-1] - offsets[0])
    length = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ids = pc.utf8_trim(flat, characters=_PUNCTUATION).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint64)
    doc = np.repeat(np.arange(count), np.diff(offsets))
    if len(ids) <= SHINGLE:
        return np.zeros(count)
    x = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    m = len(ids) - SHINGLE + 1
    h = np.zeros(m, np.uint64)
    for j in range(SHINGLE):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + x[j : j + m]
    at = np.flatnonzero(doc[SHINGLE - 1 :] == doc[:m])
    order = np.lexsort((at, h[at], doc[at]))
    hs, ds = h[at][order], doc[at][order]
    again = at[order][1:][(hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])]
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + SHINGLE, -1)
    covered = np.cumsum(step)[:-1] > 0
    rid, start, n = _runs(covered, doc)
    bridge = ~covered[start] & (n <= GAP)
    bridge[[0, -1]] = False
    bridge[1:-1] &= (doc[start][:-2] == doc[start][1:-1]) & (doc[start][2:] == doc[start][1:-1])
    covered |= bridge[rid]
    rid, start, n = _runs(covered, doc)
    covered &= (n >= MIN_RUN)[rid]
    total = np.bincount(doc, weights=length, minlength=count)
    return np.bincount(doc, weights=length * covered, minlength=count) / np.maximum(total, 1)


def compression(data: bytes, z: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratios of the whole and of the most compressible fixed chunk."""
    whole = len(data) / len(z.compress(data))
    if len(data) <= CHUNK:
        return whole, whole
    parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    return whole, max(len(p) / len(z.compress(p)) for p in parts if 2 * len(p) >= CHUNK)


def expected_ratio(n: int) -> float:
    x = math.log(max(n, 64))
    a, b, c = EXPECTED
    return a * x * x + b * x + c


def fit_expected(sizes: np.ndarray, ratios: np.ndarray) -> tuple[float, float, float]:
    """EXPECTED anew, from texts without repeats."""
    return tuple(float(x) for x in np.polyfit(np.log(np.maximum(sizes, 64)), ratios, 2))


def band(n: int, whole: float, chunk: float, words: int = MIN_RUN) -> str:
    if not n:
        return "empty"
    if n > LONG:
        return "long"
    usual = expected_ratio(n)
    if words >= MIN_RUN:
        if whole >= CERTAIN * usual:
            return "repetitive"
        if whole >= DOUBTFUL * usual or n > CHUNK and chunk >= CHUNK_DOUBTFUL * expected_ratio(CHUNK):
            return "borderline"
    return "incompressible" if whole < INCOMPRESSIBLE * usual else "plain"


def _measure(every: bool):
    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            ratios, bands, sizes = [], [], []
            for data in texts.cast(pa.binary()).to_pylist():
                w, c = compression(data, z) if data.strip() else (0.0, 0.0)
                ratios.append((w, c))
                bands.append(band(len(data) if data.strip() else 0, w, c, len(data.split(None, MIN_RUN))))
                sizes.append(len(data))
            share = np.zeros(len(texts))
            pick = np.flatnonzero([every or b in MEASURED for b in bands])
            # slices of a few million bytes keep the word arrays small whatever the batch
            cuts = np.cumsum(np.array(sizes)[pick]) // 4_000_000
            for k in np.unique(cuts):
                part = pick[cuts == k]
                share[part] = repeated_shares(texts.take(pa.array(part)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in ratios], pa.float64()), pa.array([r[1] for r in ratios], pa.float64()), pa.array(bands), pa.array(share)],
                ["doc_id", "ratio", "chunk_ratio", "band", "repeated_share"],
            )

    return run


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = True) -> DataFrame:
    """(doc_id, ratio, chunk_ratio, band, repeated_share); every=False measures the bands of MEASURED only."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_measure(every), f"doc_id {kind}, ratio double, chunk_ratio double, band string, repeated_share double")


def repetitive_documents(docs: DataFrame, least: float = 0.35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of the repetitive band, and measured ones of at least that share."""
    return repetition(docs, id_col, text_col, every=False).where((F.col("band") == "repetitive") | (F.col("band").isin(*MEASURED) & (F.col("repeated_share") >= least)))
