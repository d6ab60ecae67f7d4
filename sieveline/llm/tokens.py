"""Token counts of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import frames, materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text into pieces before byte-pair merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counted(df: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """``keep`` columns as k0, k1, ... with ``item`` (a number for each row) and ``n_tokens`` of the whole text.

    A null or empty text has no tokens. The result is written to the shared folder, so item numbers stay the same
    for all later reads.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    cols = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in pdf["text"]]
            yield from frames({c: list(pdf[c]) for c in cols} | {"n_tokens": n})

    schema = ", ".join(f"{c} {kinds[k]}" for c, k in zip(cols, keep)) + ", n_tokens long"
    return materialize(rows.mapInPandas(run, schema).withColumn("item", F.monotonically_increasing_id()), "counted")
