"""Boundaries to models, with deterministic stand-ins that need no download.

Each is a column function over Arrow batches, so a real model is loaded once per worker and fed in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(size: int = 64) -> Encoder:
    """Texts as unit vectors of hashed pairs of letters; a text without letters is a zero vector."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), dtype=np.float32)
        for row, t in zip(out, texts, strict=True):
            codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            if len(codes) > 1:
                h = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
                h ^= h >> np.uint64(29)
                np.add.at(row, (h % np.uint64(size)).astype(int), np.where(h & np.uint64(1 << 40), 1.0, -1.0))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return encode


def embed(text: Column, make: Callable[[], Encoder] = hashing_encoder, prefix: str = "", batch: int = 256) -> Column:
    """The vector of a text, null for null; ``prefix`` is set before each text once."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for s in series:
            given = s.notna()
            texts = [t if t.startswith(prefix) else prefix + t for t in s[given]]
            parts = [encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            vectors = list(np.concatenate(parts)) if parts else []
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[given] = pd.Series(vectors, index=s.index[given], dtype=object)
            yield out

    return run(text)
