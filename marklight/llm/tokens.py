"""Sizes of texts in tokens of a public tokenizer, with a few projected dimensions of what they hold."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def sized(texts: DataFrame, path: str = TOKENIZER, dims: int = 0, seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, tokens`` of ``texts(id, text)``, the columns ``keep`` as they are, and with ``dims`` the ``vector``: hashed token counts,
    projected at random.

    Null texts are left out, empty ones have no tokens and a zero vector. Whole texts are counted, in batches of some
    hundred, so that long ones don't pile up.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        r = np.random.default_rng(seed).standard_normal((1 << 16, max(dims, 1))).astype(np.float32)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                ids = [e.ids for e in t.encode_batch(list(part["text"]), add_special_tokens=False)]
                out = {"id": part["id"].to_numpy(), "tokens": [len(x) for x in ids], **{c: part[c].to_numpy() for c in keep}}
                if dims:
                    vectors = []
                    for x in ids:
                        kinds, n = np.unique(np.asarray(x, dtype=np.int64) & 0xFFFF, return_counts=True)
                        w = np.log1p(n).astype(np.float32)
                        vectors.append((w @ r[kinds] / (np.linalg.norm(w) or 1.0)).astype(float).tolist())
                    out["vector"] = vectors
                yield pd.DataFrame(out)

    t = texts.where("text is not null").select(F.col("id").cast("bigint").alias("id"), "text", *keep)
    kinds = "".join(f", {c} {t.schema[c].dataType.simpleString()}" for c in keep)
    return t.mapInPandas(rows, "id bigint, tokens bigint" + kinds + (", vector array<double>" if dims else ""))
