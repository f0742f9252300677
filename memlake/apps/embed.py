"""Text embedders."""

from __future__ import annotations

import hashlib
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


class Embedder(ABC):
    """Turns texts into vectors of one dimension."""

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    @property
    @abstractmethod
    def dimension(self) -> int: ...

    def embed_single(self, text: str) -> list[float]:
        return self.embed([text])[0]

    def column(self, text: Column) -> Column:
        """The embeddings of a text column, in Arrow batches; null for a null text."""
        own = self

        @F.pandas_udf("array<float>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for p in parts:
                known = p.notna()
                out = pd.Series([None] * len(p), index=p.index, dtype=object)
                if known.any():
                    out[known] = pd.Series([np.asarray(x, np.float32) for x in own.embed(p[known].tolist())], index=p.index[known], dtype=object)
                yield out

        return run(text)


class HashingEmbedder(Embedder):
    """Signed hashing of words and word pairs into a unit vector: needs no model and is the same everywhere."""

    def __init__(self, dimension: int = 384):
        self._dimension = dimension

    @property
    def dimension(self) -> int:
        return self._dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self._dimension))
        for row, text in zip(out, texts, strict=True):
            words = _WORD.findall(text.lower())
            for token in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                row[(h >> 1) % self._dimension] += 1 if h & 1 else -1
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(n == 0, 1, n)).tolist()


class CallableEmbedder(Embedder):
    def __init__(self, func: Callable[[list[str]], Sequence[Sequence[float]]], dimension: int):
        self.func, self._dimension = func, dimension

    @property
    def dimension(self) -> int:
        return self._dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [list(map(float, x)) for x in self.func(texts)]


def get_embedder(spec: str | Embedder | Callable | None = None, dimension: int | None = None) -> Embedder:
    """None or ``"hashing"``: the hashing embedder; an embedder as it is; a function needs its dimension."""
    if spec is None or spec == "hashing":
        return HashingEmbedder(dimension or 384)
    if isinstance(spec, Embedder):
        return spec
    if isinstance(spec, str):
        raise ValueError(f"unknown embedder: {spec}")
    if callable(spec):
        if dimension is None:
            raise ValueError("a function needs its dimension")
        return CallableEmbedder(spec, dimension)
    raise TypeError(f"not an embedder: {type(spec).__name__}")
