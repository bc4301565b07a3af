"""Counting tokens with a public tokenizer whose files are a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDER = os.environ.get("MEMLAKE_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level BPE vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from text to token ids, for a ``.tiktoken``, ``.json`` or ``.model`` file; one per process."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        return lambda text: made.encode(text, add_special_tokens=False).ids
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: model.encode(text, num_threads=1)


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens of the whole text; null and empty texts have none."""
    file = path or os.path.join(FOLDER, NAME)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(file)
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return count(text)
