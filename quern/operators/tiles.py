"""Blocks of questions meet blocks of rows: a grid of tiles, each one group of a task, and the best of each question in a tile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores are ranked to PLACES, so that sums in another order are still ties.
PLACES = 10
#: Entries of a matrix of scores that are held at once: few enough for a cache.
CELLS = 1 << 20


def packed(rows: DataFrame, number: int, name: str) -> DataFrame:
    """``<name>, ids, raw, dim``: ``rows (id, v)`` in ``number`` blocks (a row for each length of vectors in it); raw has the vectors in the column's own type, float32 or float64."""
    kind = rows.schema["id"].dataType.simpleString()
    single = rows.schema["v"].dataType.elementType.simpleString() == "float"

    def pack(table: pa.Table) -> pa.Table:
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8")
        ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table["id"].combine_chunks())
        return pa.table([table["block"][:1], ids, pa.array([x.tobytes()], pa.binary()), table["dim"][:1]], names=[name, "ids", "raw", "dim"])

    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(number)).cast("int").alias("block"), F.size("v").alias("dim"), "id", "v")
    return dealt.groupBy("block", "dim").applyInArrow(pack, f"{name} int, ids array<{kind}>, raw binary, dim int")


def units(raw: bytes, n: int, dim: int) -> np.ndarray:
    """The unit vectors of ``n`` packed ones, in double precision; zero vectors stay zero."""
    x = np.frombuffer(raw, "<f4" if len(raw) == 4 * n * dim else "<f8").reshape(n, dim).astype(np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def meet(left: DataFrame, lines: int, right: DataFrame, columns: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on every ``line`` of ``left`` and every ``column`` of ``right``: a row of blocks is sent once a column, a column once a line, and nothing is sent twice."""
    number = max(1, min(3 * lines * columns, 2000))  # more than tiles, so that few share a task
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = left.withColumn("column", each(columns)).repartition(number, "line", "column").groupBy("line", "column")
    other = right.withColumn("line", each(lines)).repartition(number, "line", "column").groupBy("line", "column")
    return own.cogroup(other).applyInArrow(run, schema)


def bound(score: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least ``k`` of it reach, at most a little below the k-th largest: that of the largest of short runs."""
    n = score.shape[1]
    if n <= k:
        return np.full(len(score), -np.inf)
    run = max(1, min(64, n // (4 * k)))
    most = score[:, : n // run * run].reshape(len(score), -1, run).max(2) if run > 1 else score
    return np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k]


def first(i: np.ndarray, j: np.ndarray, score: np.ndarray, by_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows ``i`` and columns ``j`` the k best of each row; ties to the smaller id."""
    order = np.lexsort((by_id[j], -np.round(score, PLACES), i))
    i, j, score = i[order], j[order], score[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], score[kept]


def best(score: np.ndarray, by_id: np.ndarray, k: int, above: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best of each row of a matrix, of scores over ``above`` alone."""
    low = np.maximum(bound(score, k) - 10.0 ** (1 - PLACES), np.nextafter(above, np.inf))  # least of all that count; ties with the k-th stay for now
    at = np.flatnonzero(score >= low[:, None])
    i, j = np.divmod(at, score.shape[1])
    return first(i, j, score.ravel()[at], by_id, k)


def rank_of(ids: pa.Array) -> np.ndarray:
    """The place of each id among all in order."""
    names = ids.to_numpy(zero_copy_only=False)
    return np.argsort(np.argsort(names, kind="stable"), kind="stable")


def chosen(qids: pa.Array, ids: pa.Array, parts: list, score: str) -> pa.Table:
    """The rows ``qid, id`` and ``score`` of ``parts``: row, column and score of pairs."""
    i, j, s = (np.concatenate([p[n] for p in parts]) if parts else np.empty(0, np.int64 if n < 2 else np.float64) for n in range(3))
    return pa.table([qids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s)], names=["qid", "id", score])
