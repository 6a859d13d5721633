"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a worker's stand-in remembers, at most.
WORDS = 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either length is 0."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)


class _Components(dict):
    """For each word the place of its component, twice, and one more if it counts down."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
        if len(self) >= WORDS:
            self.clear()
        self[word] = found = h % self.dim * 2 + (0 if h >> 63 else 1)
        return found


def hashing_model(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an embedding model: words hashed to signed components, at length 1."""
    known = _Components(dim)  # words recur

    def encode(texts: list[str]) -> list[list[float]]:
        words = [(text or "").lower().split() for text in texts]
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64)
        of = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        v = np.bincount(of * dim + at // 2, 1.0 - 2 * (at % 2), len(texts) * dim).reshape(len(texts), dim)
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))  # of whole numbers, so sums are exact in any order
        return (v / np.where(size > 0, size, 1.0)).tolist()

    return encode


def embed(text: Column, model: Callable[[list[str]], list[list[float]]], dim: int) -> Column:
    """Vectors by an injected model, batch by batch; a vector of another size is an error."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        found = model(texts.tolist())
        if any(len(v) != dim for v in found):
            raise ValueError(f"the model returned vectors that don't have {dim} components")
        return pd.Series(found, index=texts.index, dtype=object)

    return run(text)
