"""Embeddings fitted to a corpus: hashed byte n-grams weighted by TF-IDF, projected on their leading singular directions.

Words that share stems share n-grams, and n-grams that occur together share directions, so texts of one kind come near each other without
common words. Fitting is a randomized SVD: every pass multiplies the documents with a thin matrix and back, summed by task, so
that only features * (dimension + OVERSAMPLE) numbers travel, whatever the corpus' size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.embedding import Provider

#: Lengths of the n-grams, in bytes, with a space on both sides of each word.
GRAMS = (3, 4, 5)
#: Directions beyond the wanted ones while fitting.
OVERSAMPLE = 10
#: Texts that are multiplied at once.
TOGETHER = 256


_PRIME, _SHIFT = np.uint64(0x100000001B3), np.uint64(29)


def _starts(n: int) -> np.ndarray:
    """Hashes of the two first bytes of an n-gram, by 256 * first + second."""
    h, both = np.full(1 << 16, n, np.uint64), np.arange(1 << 16, dtype=np.uint64)
    for byte in (both >> np.uint64(8), both & np.uint64(255)):
        h = (h ^ byte) * _PRIME
        h ^= h >> _SHIFT
    return h


_STARTS = {n: _starts(n) for n in GRAMS}


def grams(text: str, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of a text: its lower-cased words joined by single spaces, all n-grams hashed."""
    small = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8)
    data, pairs, total = small.astype(np.uint64), small[:-1].astype(np.uint16) << 8 | small[1:], np.zeros(features, np.int64)
    for n in GRAMS:
        if (m := len(data) - n + 1) > 0:
            h = _STARTS[n][pairs[:m]]
            for k in range(2, n):
                h ^= data[k : k + m]
                h *= _PRIME
                h ^= h >> _SHIFT
            h = h % np.uint64(features) if features & features - 1 else h & np.uint64(features - 1)
            total += np.bincount(h.view(np.int64), minlength=features)
    found = np.flatnonzero(total)
    return found, total[found]


def _weighted(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """The texts' unit rows of (1 + log count) * idf; a zero row for a text without n-grams that count."""
    out = np.zeros((len(texts), len(idf)), np.float32)
    for row, text in zip(out, texts):
        at, n = grams(text, len(idf))
        row[at] = (1 + np.log(n)) * idf[at]
        if norm := np.linalg.norm(row):
            row /= norm
    return out


def _summed(texts: DataFrame, make, rows: int, width: int) -> np.ndarray:
    """The sum over tasks of matrices (rows, width) that make(texts) gives for slices of texts; packed by the row on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for batch in batches:
            some = [x for x in batch.column("text").to_pylist() if x]
            for k in range(0, len(some), TOGETHER):
                total += make(some[k : k + TOGETHER])
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([x.tobytes() for x in total[used]], pa.binary())], ["row", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, packed in zip(batch.column("row").to_pylist(), batch.column("packed").to_pylist()):
                part = np.frombuffer(packed)
                total[row] = total[row] + part if row in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["row", "packed"])

    out = np.zeros((rows, width))
    schema = "row int, packed binary"
    for r in texts.mapInArrow(run, schema).repartition("row").mapInArrow(add, schema).collect():  # a row per feature
        out[r["row"]] = np.frombuffer(r["packed"])
    return out


def fit(texts: DataFrame, dimension: int = 64, features: int = 4096, passes: int = 3, seed: int = 1, name: str = "fitted") -> Provider:
    """A provider fitted to all rows of texts (text). Null and blank texts are left out; an empty table gives a provider of zero vectors.

    dimension + OVERSAMPLE must not exceed features. Its vectors are of unit length, but zero for texts without any known n-gram.
    """
    rows = texts.select("text")
    n = rows.where("trim(text) <> ''").count()

    def present(some: list[str]) -> np.ndarray:
        out = np.zeros((features, 1))
        for text in some:
            out[grams(text, features)[0], 0] += 1
        return out

    df = _summed(rows, present, features, 1)[:, 0]
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0).astype(np.float32)
    basis = np.random.default_rng(seed).standard_normal((features, dimension + OVERSAMPLE))
    basis[df == 0] = 0
    for _ in range(passes):
        shared = texts.sparkSession.sparkContext.broadcast((idf, basis.astype(np.float32)))

        def multiply(some: list[str], shared=shared) -> np.ndarray:
            weights, thin = shared.value
            x = _weighted(some, weights)
            return (x.T @ (x @ thin)).astype(np.float64)

        product = _summed(rows, multiply, features, basis.shape[1])
        shared.destroy()
        # Directions in the order of what the last pass found along them.
        u, _, _ = np.linalg.svd(product, full_matrices=False)
        basis = u
    directions = basis[:, :dimension].astype(np.float32)

    def embed(some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), dimension), np.float32)
        for k in range(0, len(some), TOGETHER):
            out[k : k + TOGETHER] = _weighted(some[k : k + TOGETHER], idf) @ directions
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-6)

    return Provider(name, dimension, embed)
