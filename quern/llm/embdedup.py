"""Embedding near-dedup: links of vectors with a cosine of at least the threshold.

Equal vectors are first counted as one. All others meet in tiles of two blocks: the
product of their int8 copies gives every cosine within a rigorous bound from the two
vectors' quantisation errors. Pairs surely below the threshold are done, pairs surely
above it are links, and only those between are computed again in double precision.
A tile returns the number of links of each of its vectors and a spanning forest of
its links, never the pairs. Components come from large-star and small-star.

Vectors that are null, zero or hold null or non-finite components link with nothing;
neither do rows without an id (component null, kept). Rows that repeat an id are
vectors of their own with one name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch
from quern.llm.components import components
from quern.llm.vectors import Quantised, blocks, clean, exact, how_many, kind_of, products, unpack


def forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the trees of i and j; the smallest position is the root."""
    while True:
        a, b = parent[i], parent[j]
        if (a == b).all():
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def tile(x: np.ndarray, wx: np.ndarray, y: np.ndarray | None, wy: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted numbers of links and forest parents over the rows of x, then y; y None: x with itself."""
    nx = len(x)
    both = x if y is None else np.concatenate((x, y))
    weight = wx if y is None else np.concatenate((wx, wy))
    a = Quantised.of(x)
    b = a if y is None else Quantised.of(y)
    ca = a.codes
    cb = ca if y is None else b.codes
    base = 0 if y is None else nx
    links, parent = np.zeros(len(both), np.int64), np.arange(len(both))
    norm = np.sqrt(exact(both, np.arange(len(both)), both, np.arange(len(both))))
    # in units of the norms: scales, lengths of the int8 copies, and errors
    sa, na, ea = (v / a.norm for v in (a.scale, a.near, a.error))
    sb, nb, eb = (v / b.norm for v in (b.scale, b.near, b.error))
    rough = na * eb.max() + ea + 4e-6 * na * nb.max()  # a row's bound for any partner
    floor = ((least * (1 - 1e-9) - rough) / sa).astype(np.float32) - np.float32(1e-6)
    step = sb.astype(np.float32)
    for at in range(0, nx, 512):
        # int8 codes in float32: their products are exact whole numbers
        dot = ca[at : at + 512] @ cb.T if ca.shape[1] <= 1024 else products(a, ca, b, cb, slice(at, at + 512))[0] / (a.scale[at : at + 512, None] * b.scale[None, :])
        dot *= step
        high = dot >= floor[at : at + 512, None] * np.where(floor[at : at + 512, None] > 0, np.float32(1 - 1e-6), np.float32(1 + 1e-6))
        i, j = np.nonzero(high)
        if y is None:
            later = j > i + at
            i, j = i[later], j[later]
        near = dot[i, j].astype(np.float64) * sa[i + at]
        bound = na[i + at] * eb[j] + ea[i + at] + 4e-6 * na[i + at] * nb[j]
        sure = near - bound >= least * (1 + 1e-9)
        open_ = np.flatnonzero(~sure & (near + bound >= least * (1 - 1e-9)))
        p, q = i[open_] + at, j[open_] + base
        sure[open_] = exact(both, p, both, q) / (norm[p] * norm[q]) >= least
        i, j = i[sure] + at, j[sure] + base
        links += np.bincount(i, weight[j], len(both)).astype(np.int64) + np.bincount(j, weight[i], len(both)).astype(np.int64)
        parent = forest(parent, i, j)
    return links, parent


def link(vectors: DataFrame, scratch: Scratch, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 8192) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    kind = kind_of(vectors, vector_col)
    cleaned = scratch.save(clean(vectors, id_col, vector_col))
    groups = scratch.save(cleaned.groupBy("dim", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    number = how_many(groups.count(), block_rows, 8)
    # a vector's number of copies travels behind its components
    tail = F.to_binary(F.hex("copies"), F.lit("hex"))
    packed = blocks(groups.select("id", "dim", F.concat("vec", F.lpad(tail, F.lit(8), F.lit(b"\x00"))).alias("vec")), number)
    pair = F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    grid = packed.select("*", pair.alias("other")).select("dim", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "ids", "rows")

    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        parts = []
        for own, ids, raw in sorted(zip(table["block"].to_pylist(), table["ids"].to_pylist(), table["rows"].to_pylist())):
            ids, x, copies = unpack(ids, raw, dim, kind, behind=8)
            parts.append((ids, x, np.ascontiguousarray(copies).view(">i8")[:, 0].astype(np.int64)))
        if len(parts) == 1 and table["lo"][0].as_py() != table["hi"][0].as_py():
            parts = []  # the other block is empty
        names = [("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())]
        if not parts:
            return pa.table([[], [], []], schema=pa.schema(names))
        (ids, x, w), (other, y, wy) = parts[0], (parts[1] if len(parts) > 1 else (None, None, None))
        links, parent = tile(x, w, y, wy, least)
        ids = ids if other is None else np.concatenate((ids, other))
        some = np.flatnonzero(links)
        return pa.table([ids[some], ids[parent[some]], links[some]], schema=pa.schema(names))

    found = scratch.save(grid.groupBy("dim", "lo", "hi").applyInArrow(run, "u long, v long, links long"))
    roots = scratch.save(components(found.select("u", "v"), scratch))
    counts = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "id")
    # groups with the same smallest id (a repeated one) are one node; each keeps its own name
    named = groups.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "id").alias("root"))
    rows = cleaned.join(named, ["dim", "vec"]).select("id", "links", "root")
    whole = vectors.select(F.col(id_col).alias("vec_id"))
    # vectors that take no part have no row in cleaned
    single = rows.groupBy("id").agg(F.max("links").alias("links"), F.min("root").alias("root"))
    out = whole.join(single, F.col("vec_id") == F.col("id"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", F.col("vec_id").cast("long")))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
