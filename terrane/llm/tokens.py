"""Token counts of texts by a public byte-level BPE vocabulary, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Where the vocabulary lies; another path can be given to each operator, or by this variable.
VOCABULARY = os.environ.get("TERRANE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# fixed value: the split pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


def encoder(path: str = VOCABULARY):
    """The encoder of a vocabulary file, once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(texts: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` BIGINT of the whole text; a null text has none."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema.fields)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for frame in frames:
            out = frame[keep].copy()
            out["n_tokens"] = [len(encode(t)) if t else 0 for t in frame["__text"]]
            yield out

    return texts.select(*keep, texts[text].alias("__text")).mapInPandas(count, f"{columns}, n_tokens bigint")
