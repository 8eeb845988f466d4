"""Embedding providers: a registry, a deterministic hashing provider, and the DataFrame operator."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimensions of the local models by name; an unknown name means the first.
LOCAL_MODELS = {"all-MiniLM-L6-v2": 384, "all-MiniLM-L12-v2": 384, "all-mpnet-base-v2": 768, "bge-small-en-v1.5": 384}


@dataclass(frozen=True)
class Provider:
    """Turns a batch of texts into vectors of one dimension. embed runs in Python workers."""

    name: str
    dimension: int
    embed: Callable[[list[str]], np.ndarray]


def hashing_provider(dimension: int = 384) -> Provider:
    """Signed hashed words, scaled to unit length. It needs no weights; it knows words, not meanings."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dimension] += 1 if h >> 31 else -1
            norm = np.linalg.norm(row)
            if norm:
                row /= norm
        return out

    return Provider("hashing", dimension, embed)


def local_dimension(model: str) -> int:
    """The dimension of a local model by its name, with or without an organisation before a slash; that of the first one for unknown names."""
    return LOCAL_MODELS.get(model.rpartition("/")[2], next(iter(LOCAL_MODELS.values())))


def local_provider(model: str) -> Provider:
    """A stand-in for a local model without its weights: hashed words in the model's dimension."""
    return replace(hashing_provider(local_dimension(model)), name=model)


def indexed_provider(name: str, dimension: int, call: Callable[[list[str]], list[tuple[int, list[float]]]]) -> Provider:
    """A provider over a service whose answers (index, vector) come in any order; an answer that is missing or comes twice is an error."""

    def embed(texts: list[str]) -> np.ndarray:
        answers = call(texts) if texts else []
        if sorted(k for k, _ in answers) != list(range(len(texts))):
            raise ValueError("not one vector for each text")
        out = np.zeros((len(texts), dimension), np.float32)
        for k, vector in answers:
            out[k] = vector
        return out

    return Provider(name, dimension, embed)


@dataclass
class Registry:
    """Providers by name; the first one registered is active until another is chosen."""

    providers: dict[str, Provider] = field(default_factory=dict)
    active: str | None = None

    def register(self, provider: Provider) -> None:
        self.providers[provider.name] = provider
        self.active = self.active or provider.name

    def set_active(self, name: str) -> None:
        if name not in self.providers:
            raise KeyError(f"no provider named {name}")
        self.active = name

    def names(self) -> list[str]:
        return sorted(self.providers)

    def current(self) -> Provider:
        if self.active is None:
            raise LookupError("no provider is registered")
        return self.providers[self.active]


def with_fallback(first: Provider, second: Provider) -> Provider:
    """first, and second for batches on which first fails."""
    if first.dimension != second.dimension:
        raise ValueError("the providers' dimensions differ")

    def embed(texts: list[str]) -> np.ndarray:
        try:
            return first.embed(texts)
        except Exception:
            return second.embed(texts)

    return Provider(f"{first.name}, else {second.name}", first.dimension, embed)


def embed_column(text: Column, provider: Provider) -> Column:
    """The vectors of a text column, by batches; null for null texts."""
    run = provider.embed

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = iter(run([x for x in texts if x is not None]))
            yield pd.Series([None if x is None else next(vectors).tolist() for x in texts], dtype=object)

    return embed(text)


def embed_texts(rows: DataFrame, provider: Provider, text: str = "text") -> DataFrame:
    return rows.withColumn("embedding", embed_column(F.col(text), provider))
