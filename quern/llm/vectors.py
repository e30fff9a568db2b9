"""Vectors in blocks: int8 copies with error bounds, and the grid of block pairs.

A block is one row that holds the ids and the matrix of a few thousand vectors, in the
type of the column: components of type float travel in four bytes, which loses nothing,
and become double precision inside a tile. The int8 copies are made there too: that is
one pass over two blocks where their product takes thousands. Blocks of int8 copies
alone would be smaller, but then every pair that the bounds leave open would have to be
shuffled to its vectors, and among many near copies those are nearly all pairs.
Blocks meet through an equi-join on their numbers. Vectors that are null, zero or
hold null or non-finite components, and rows without an id, are in no block; vectors
of another dimension are never compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

BLOCK_SCHEMA = "block int, dim int, n int, ids binary, rows binary"


def kind_of(vectors: DataFrame, vector_col: str) -> str:
    """Numpy's name of the type in which components travel: that of the column if it is float, else double."""
    return "<f4" if vectors.select(vector_col).schema[0].dataType.elementType == FloatType() else "<f8"


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id long, dim int, vec binary`` (of ``kind_of``, little-endian) of the vectors that take part."""
    kind = kind_of(vectors, vector_col)

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            whole = pc.and_(ids.is_valid(), lists.is_valid())
            batch = batch.filter(whole)
            ids, lists = batch.column(0), batch.column(1)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            end = np.cumsum(size, dtype=np.int64)
            begin = end - size
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            some = np.concatenate(([0], np.cumsum(flat != 0)))
            ok = (bad[end] == bad[begin]) & (some[end] > some[begin])
            raw = flat.astype(kind)
            vec = [raw[a:b].tobytes() for a, b in zip(begin[ok], end[ok])]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok, pa.bool_())).cast(pa.int64()), pa.array(size[ok], pa.int32()), pa.array(vec, pa.binary())], names=["id", "dim", "vec"])

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, dim int, vec binary")


def blocks(cleaned: DataFrame, number: int) -> DataFrame:
    """``number`` blocks for each dimension, dealt by a hash of the id, so of even size whatever the vectors."""

    def pack(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("id", "ascending")])
        table = table.take(order)
        return pa.table([[table["block"][0].as_py()], [table["dim"][0].as_py()], [table.num_rows], [table["id"].to_numpy().astype("<i8").tobytes()], [b"".join(table["vec"].to_pylist())]], schema=pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())]))

    block: Column = F.pmod(F.xxhash64("id"), F.lit(number)).cast("int").alias("block")
    return cleaned.select(block, "dim", "id", "vec").groupBy("dim", "block").applyInArrow(pack, BLOCK_SCHEMA)


@dataclass
class Quantised:
    """x = scale * q + e, with q int8 and |e| <= error, for each row."""

    x: np.ndarray
    q: np.ndarray
    scale: np.ndarray
    norm: np.ndarray
    near: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Quantised:
        scale = np.abs(x).max(1) / 127
        scale = np.where(scale > 0, scale, 1.0)
        q = np.rint(x / scale[:, None]).astype(np.int8)
        back = q * scale[:, None]
        norm, near, error = (np.sqrt((y * y).sum(1)) for y in (x, back, x - back))
        return cls(x, q, scale, norm, near, error * (1 + 1e-12) + 1e-300)

    @property
    def codes(self) -> np.ndarray:
        """The int8 codes as float32: products of up to 1,000 of them are exact whole numbers there, and BLAS is fast."""
        return self.q.astype(np.float32)


def products(a: Quantised, ca: np.ndarray, b: Quantised, cb: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products of a[rows] with all of b, and bounds of their errors (float32 rounding included)."""
    dot = np.zeros((len(ca[rows]), len(cb)), np.float32)
    for at in range(0, ca.shape[1], 1024):
        dot += ca[rows, at : at + 1024] @ cb[:, at : at + 1024].T
    dot *= a.scale[rows, None].astype(np.float32)
    dot *= b.scale[None, :].astype(np.float32)
    reach = (a.near[rows] * 2e-6)[:, None] * b.near[None, :]
    bound = a.near[rows, None] * b.error[None, :] + a.error[rows, None] * b.norm[None, :] + reach
    return dot, bound.astype(np.float32) * np.float32(1.000001)


def exact(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of a[i] with b[j] in double precision, summed in the order of the components: equal vectors have equal products."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 1 << 16):
        x, y = a[i[at : at + (1 << 16)]], b[j[at : at + (1 << 16)]]
        total = np.zeros(len(x))
        for d in range(x.shape[1]):
            total += x[:, d] * y[:, d]
        out[at : at + (1 << 16)] = total
    return out


def unpack(ids: bytes, rows: bytes, dim: int, kind: str, behind: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, its matrix in double precision, and the ``behind`` further bytes of each vector."""
    row = np.frombuffer(rows, np.dtype([("x", kind, (dim,)), ("behind", np.uint8, (behind,))]))
    return np.frombuffer(ids, "<i8"), row["x"].astype(np.float64), row["behind"]


def how_many(n: int, most: int, least_tiles: int) -> int:
    """Blocks of at most about ``most`` rows, and enough of them to occupy the cluster."""
    return max(-(-n // most), min(least_tiles, -(-n // 256)), 1)
