"""Nearest neighbours by a block matrix join.

The stated queries and all rows are dealt into blocks. For each pair of a query block
and a row block, the product of the int8 copies gives every inner product within a
rigorous bound. Only pairs whose upper bound reaches the k-th best lower bound of
their query are computed again in double precision; heaps keep the k best from block
to block inside a tile, and a ranked window merges the tiles. The result is exact.

Ties go to the smaller id. A query is never its own neighbour; with fewer candidates
than k all are returned; a query that takes no part (null, zero or non-finite vector)
has no rows. Of rows that repeat an id, a query's nearest one counts and the others take
no place: rows that repeat the vector too are made one first, and heaps and bounds count
ids. Of equal vectors only the k + 1 with the smallest ids are candidates: the others have
k nearer ones for any query, since ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch
from quern.llm.vectors import Quantised, blocks, clean, exact, how_many, kind_of, products, unpack

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def first_of(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of a query and a candidate with their scores, each query's k nearest different candidates."""
    order = np.lexsort((-s, c, q))
    q, c, s = q[order], c[order], s[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
    q, c, s = q[once], c[once], s[once]
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    ahead = np.zeros(len(q), bool)  # k places further up is the same query: k of its candidates are nearer
    ahead[k:] = q[k:] == q[:-k]
    return q[~ahead], c[~ahead], s[~ahead]


def tile(qids: np.ndarray, qs: np.ndarray, cids: np.ndarray, cs: np.ndarray, k: int, step: int = 4096) -> list[tuple[int, int, float]]:
    """(query, candidate, score) of the k nearest candidates of each query."""
    a = Quantised.of(qs)
    ca = a.codes
    best: list[list[tuple[float, int]]] = [[] for _ in qids]
    held: list[dict[int, float]] = [{} for _ in qids]
    for at in range(0, len(cids), step):
        b = Quantised.of(cs[at : at + step])
        cb, own = b.codes, cids[at : at + step]
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
        for lo in range(0, len(qids), 512):
            rows = slice(lo, lo + 512)
            dot, bound = products(a, ca, b, cb, rows)
            same = qids[rows, None] == own[None, :]
            low = np.where(same, -np.inf, dot - bound)
            floor = np.array([h[0][0] if len(h) == k else -np.inf for h in best[rows]])
            if len(first) < len(own):
                low = np.maximum.reduceat(low[:, order], first, axis=1)
            if len(first) > k:
                floor = np.maximum(floor, np.partition(low, len(first) - k, axis=1)[:, len(first) - k])
            i, j = np.nonzero((dot + bound >= floor[:, None]) & ~same)
            for q, c, s in zip(*(part.tolist() for part in first_of(i + lo, own[j], exact(qs, i + lo, b.x, j), k))):
                heap, ids, item = best[q], held[q], (s, -c)
                if c in ids:
                    if s > ids[c]:
                        heap[heap.index((ids[c], -c))] = item
                        heapq.heapify(heap)
                        ids[c] = s
                elif len(heap) < k:
                    heapq.heappush(heap, item)
                    ids[c] = s
                elif item > heap[0]:
                    del ids[-heapq.heapreplace(heap, item)[1]]
                    ids[c] = s
    return [(int(q), -c, s) for q, heap in zip(qids, best) for s, c in heap]


def nearest(vectors: DataFrame, is_query: Column, scratch: Scratch, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of each row with ``is_query`` by inner product."""
    kind = kind_of(vectors, vector_col)
    same = Window.partitionBy("dim", "vec").orderBy("id")
    rows = scratch.save(clean(vectors, id_col, vector_col).distinct().withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n"))
    asked = scratch.save(clean(vectors.filter(is_query), id_col, vector_col).distinct())
    n, m = rows.count(), asked.count()
    cols = how_many(n, block_rows, 24)
    lines = how_many(m, block_rows, 1)
    right = blocks(rows, cols).select("block", "dim", F.col("ids").alias("cids"), F.col("rows").alias("cs"))
    left = blocks(asked, lines).select("dim", F.col("block").alias("line"), F.col("ids").alias("qids"), F.col("rows").alias("qs"))
    # the grid: a row block for every line of query blocks, met by an equi-join
    spread = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"))
    tiles = spread.join(left, ["dim", "line"]).select("dim", "qids", "qs", "cids", "cs").repartition(F.xxhash64("qids", "cids"))

    def run(batches):
        for batch in batches:
            for x in range(batch.num_rows):
                dim, *raw = (batch.column(c)[x].as_py() for c in range(5))
                (qids, qs, _), (cids, cs, _) = unpack(raw[0], raw[1], dim, kind), unpack(raw[2], raw[3], dim, kind)
                found = tile(qids, qs, cids, cs, k)
                q, c, s = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], schema=_OUT)

    found = tiles.mapInArrow(run, "query_id long, vec_id long, score double")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
