"""Sizes of texts in tokens of a public tokenizer; its file's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str | None = None):
    """The tokenizer of a rank file. It must lie at ``path`` on every worker."""
    import tiktoken

    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str, text: str, path: str = TOKENIZER, pattern: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *keep, n_tokens)``: the tokens of each whole text. Null and empty
    texts have 0; the strings of special tokens are ordinary text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch["_t"]]
            yield batch.drop(columns="_t").assign(n_tokens=np.asarray(n, np.int64))

    rows = df.select(F.col(key), *keep, F.col(text).alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_t")
    return rows.mapInPandas(run, f"{schema}, n_tokens long")
