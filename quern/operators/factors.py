"""A learned embedding: latent semantic factors of the corpus by block power iteration.

A text is a sparse row: its content words hashed to ``buckets``, weighted by their logarithmic count and the
bucket's rarity, of unit length. ``train`` finds the ``dim`` leading right singular vectors of all rows: each
round multiplies a block of vectors by the matrix and its transpose - a task keeps its rows, and gives
one dense row a bucket that its texts have, which are added up by bucket - and makes the block orthonormal again. A last
small eigenproblem turns the block into singular vectors. What passes through the driver is buckets x dim
numbers, whatever the corpus holds. An embedding is a row's product with the vectors, of unit length.

Null and empty texts, and texts without a known word, are zero vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

#: Rows whose entries are multiplied at once.
ROWS = 500


@dataclass(frozen=True)
class Params:
    dim: int = 64
    buckets: int = 1 << 14
    rounds: int = 6
    #: Leading vectors that are left out: they mostly tell languages apart, and texts with many common words from others.
    skip: int = 4


@dataclass(frozen=True)
class Factors:
    #: buckets x dim, orthonormal columns; the values that they belong to; a bucket's rarity.
    vectors: np.ndarray
    values: np.ndarray
    idf: np.ndarray
    residual: float = field(default=0.0, compare=False)


def _buckets(text: Column, n: int) -> Column:
    return F.transform(T.content_words(F.coalesce(text, F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"))


def _entries(lists: pa.ListArray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and number of the distinct buckets of lists."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    key, n = np.unique(np.repeat(np.arange(len(lists)), sizes) * buckets + lists.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    return key // buckets, key % buckets, n


def _weighted(row: np.ndarray, col: np.ndarray, n: np.ndarray, rows: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight of the entries of rows of unit length."""
    weight = (1 + np.log(n)) * idf[col]
    norm = np.sqrt(np.bincount(row, weight * weight, rows))
    return row, col, weight / np.maximum(norm[row], 1e-300)


def _times(row: np.ndarray, col: np.ndarray, weight: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, v.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(weight[:, None] * v[col], starts)
    return out


def _product(rows: DataFrame, v: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The transpose of the matrix, times the matrix, times ``v``."""
    held = rows.sparkSession.sparkContext.broadcast((v, idf))
    names = [f"c{k}" for k in range(v.shape[1])]

    def run(batches):
        v, idf = held.value
        total, met = np.zeros_like(v), np.zeros(len(v), bool)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sizes = part.column(0).value_lengths().to_numpy().astype(np.int64)
                cols, counts = (part.column(c).flatten().to_numpy() for c in (0, 1))
                row, col, weight = _weighted(np.repeat(np.arange(len(sizes)), sizes), cols, counts, len(sizes), idf)
                y = _times(row, col, weight, v, len(sizes))
                order = np.argsort(col, kind="stable")
                total += _times(col[order], row[order], weight[order], y, len(v))
                met[col] = True
        own = np.flatnonzero(met)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(total[own, k]) for k in range(v.shape[1]))], names=["bucket", *names])

    parts = rows.mapInArrow(run, ", ".join(["bucket int", *(f"{c} double" for c in names)]))
    summed = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # a row a bucket
    out = np.zeros_like(v)
    if summed.num_rows:
        out[summed["bucket"].to_numpy()] = np.stack([summed[c].to_numpy() for c in names], 1)
    held.destroy()
    return out


def train(docs: DataFrame, text_col: str = "text", p: Params = Params(), save=lambda df: df) -> Factors:
    """Factors of all texts. ``save`` writes a table that is read in every round, and gives it back."""

    def counted(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.column(0).slice(at, ROWS)
                row, col, n = _entries(part, p.buckets)
                offsets = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (col, n)], names=["b", "n"])

    # counted once for all rounds, and dealt evenly
    lists = docs.select(_buckets(F.col(text_col), p.buckets).alias("b"))
    rows = save(lists.mapInArrow(counted, "b array<int>, n array<int>").repartition(3 * docs.sparkSession.sparkContext.defaultParallelism))
    counts = rows.select(F.explode("b").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df")).toArrow()  # a row a bucket
    n, df = max(1, rows.count()), np.zeros(p.buckets)
    df[counts["bucket"].to_numpy()] = counts["df"].to_numpy()
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1e-3, 0.0)
    width = p.dim + p.skip
    v = np.linalg.qr(np.random.Generator(np.random.PCG64(5)).normal(size=(p.buckets, width)))[0]
    for _ in range(p.rounds):
        v = np.linalg.qr(_product(rows, v, idf))[0]
    made = _product(rows, v, idf)
    values, turn = np.linalg.eigh(v.T @ made)
    order = np.argsort(-values)
    v, made, values = v @ turn[:, order], made @ turn[:, order], np.maximum(values[order], 0)
    off = np.sqrt(((made - v * values) ** 2).sum(0))
    return Factors(v[:, p.skip :], np.sqrt(values[p.skip :]), idf, float((off / max(values[0], 1e-300)).max()))


def embedding(text: Column, factors: Factors) -> Column:
    """The unit vector of a text in the space of the factors, which go to the executors with the expression: buckets x dim numbers."""

    @F.pandas_udf("array<double>")
    def placed(lists: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(lists), ROWS):
            part = pa.array(lists.iloc[at : at + ROWS], pa.list_(pa.int32()))
            y = _times(*_weighted(*_entries(part, len(factors.idf)), len(part), factors.idf), factors.vectors, len(part))
            out += list(y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-300))
        return pd.Series(out)

    return placed(_buckets(text, len(factors.idf)))


@dataclass(frozen=True)
class LearnedEmbedder:
    """An embedder for the engine: ``Models(embedder=LearnedEmbedder(train(chunks)))``. Another training is another name."""

    factors: Factors

    @property
    def dim(self) -> int:
        return self.factors.vectors.shape[1]

    @property
    def name(self) -> str:
        return f"factors-{self.dim}-{crc32(self.factors.values.tobytes()):08x}"

    def documents(self, text: Column) -> Column:
        return embedding(text, self.factors)

    def queries(self, text: Column) -> Column:
        return embedding(text, self.factors)
