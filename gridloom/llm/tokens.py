"""Token sizes of texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import os

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Vocabulary of ranks (one base64 token and its rank a line); every executor must see the path.
VOCABULARY = os.environ.get("GRIDLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how this vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The kept columns and n_tokens (bigint); a null text has none."""
    kept = docs.select(*keep, text_col)
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens bigint"])

    def run(batches):
        enc = encoding(path)
        for b in batches:
            texts = pc.fill_null(b.column(len(keep)), "")
            n = pa.array([len(enc.encode_ordinary(t.as_py())) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*keep, "n_tokens"])

    return kept.mapInArrow(run, schema)
