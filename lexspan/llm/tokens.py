"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabulary of ranks used where none is given; the folder comes from the environment or the default place.
DEFAULT_VOCABULARY = os.path.join(os.environ.get("LEXSPAN_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken")
#: The published pre-tokenizer pattern of byte-level BPE vocabularies of this family (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per Python process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def n_tokens(text: Column | str, path: str | None = None) -> Column:
    """The number of tokens of the whole text; 0 for null."""
    path = path or DEFAULT_VOCABULARY

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    # Not to be repeated by the optimizer for a filter on its result.
    return count.asNondeterministic()(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
