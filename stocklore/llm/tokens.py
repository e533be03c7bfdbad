"""Token counts with a public tokenizer whose files lie outside the repository."""

from __future__ import annotations

import base64
import importlib.util
import os
import sys
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(2)
def encoding(folder: str, vocabulary: str):
    """A tiktoken encoding from a rank file; one per Python worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers_files", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    sys.modules.setdefault(spec.name, module)
    spec.loader.exec_module(module)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, vocabulary).read_bytes().splitlines())}
    return tiktoken.Encoding(vocabulary, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of whole texts (INT); null and empty texts have 0."""

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        encode = encoding(folder, vocabulary).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in s], dtype="int32")

    return count(text)
