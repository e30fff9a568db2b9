"""Approximate nearest neighbours: an inverted file of trained cells, with product codes of the residuals.

``write_ivf`` trains on a bounded sample (``Params.sample``): cells by spherical k-means, and for each stretch of a vector
a book of residuals. All rows are then assigned and coded, and laid in blocks of at most ``block_rows`` within
their cell, so a cell that a third of all rows fall into is many blocks. ``search`` asks each question's
nearest ``probes`` cells: codes give approximate cosines, and the best ``refine * k`` of each
block are scored again from the vectors themselves. With all cells and a ``refine`` beyond a block's rows the search
is exact; ``retrieval.dense_topk`` is exact without an index.

Vectors that are null, empty or of another length than most, or hold null or non-finite components take no part. A zero
vector has cosine 0 with all others. Ties go to the smaller id. Rows that repeat an id are rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import tiles
from quern.operators.retrieval import ranked


@dataclass(frozen=True)
class Params:
    cells: int = 64
    #: Stretches of a vector, and entries of each stretch's book (at most 256).
    stretches: int = 16
    entries: int = 64
    rounds: int = 12
    #: Most rows that are trained on, drawn by a hash of the id.
    sample: int = 50_000
    block_rows: int = 4096


def _means(x: np.ndarray, k: int, rounds: int, unit: bool) -> np.ndarray:
    """k-means from rows drawn with a fixed seed; a cell that loses all rows takes the row that fits worst."""
    draw = np.random.Generator(np.random.PCG64(7))
    means = x[draw.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = x @ means.T - 0.5 * (means * means).sum(1)
        own, fit = near.argmax(1), near.max(1) - 0.5 * (x * x).sum(1)
        count = np.bincount(own, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, own, x)
        full = count > 0
        means[full] = sums[full] / count[full, None]
        means[~full] = x[np.argsort(fit)[: (~full).sum()]]
        if unit:
            means /= np.maximum(np.sqrt((means * means).sum(1, keepdims=True)), 1e-300)
    return means


@dataclass(frozen=True)
class Model:
    cells: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes of unit vectors."""
        cell = (x @ self.cells.T).argmax(1)
        rest = x - self.cells[cell]
        codes = [((rest[:, a:b] @ book.T) - 0.5 * (book * book).sum(1)).argmax(1) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]
        return cell, np.stack(codes, 1).astype(np.uint8)


def train(x: np.ndarray, p: Params) -> Model:
    cells = _means(x, p.cells, p.rounds, True)
    rest = x - cells[(x @ cells.T).argmax(1)]
    cuts = [x.shape[1] * i // p.stretches for i in range(p.stretches + 1)]
    cuts = sorted(set(cuts))
    return Model(cells, [_means(rest[:, a:b], min(p.entries, 256), p.rounds, False) for a, b in zip(cuts, cuts[1:])], cuts)


def _units(df: DataFrame, id_col: str, vector_col: str, wide: bool = True) -> DataFrame:
    """``id, v``: usable vectors in double precision, or as they are."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(v.isNotNull() & (F.size(v) > 0) & whole).select(F.col(id_col).alias("id"), (F.transform(v, lambda x: x.cast("double")) if wide else v).alias("v"))


def _matrix(column) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def write_ivf(vectors: DataFrame, path: str, p: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """The tables ``model`` (one row) and ``blocks (cell, ids, codes, raw)`` under ``path``."""
    rows = _units(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes["dim"] if sizes else 1
    rows = rows.filter(F.size("v") == dim)
    drawn = rows.withColumn("h", F.xxhash64("id")).orderBy("h").limit(p.sample).select("v").toArrow()  # bounded by p.sample
    model = train(_matrix(drawn["v"]) if drawn.num_rows else np.zeros((1, dim)), p)
    books = [(a, b, book.astype("<f8").tobytes()) for a, b, book in zip(model.cuts, model.cuts[1:], model.books)]
    spark.createDataFrame([(dim, model.cells.astype("<f8").tobytes(), books)], "dim int, cells binary, books array<struct<a:int,b:int,raw:binary>>").write.mode("overwrite").parquet(f"{path}/model")
    held = spark.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                cell, codes = held.value.assign(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "v", "cell", "code"])

    def packed(table: pa.Table) -> pa.Table:
        ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table["id"].combine_chunks())
        raw = _matrix(table["v"]).astype("<f8").tobytes()
        return pa.table([table["cell"][:1], ids, pa.array([b"".join(table["code"].to_pylist())], pa.binary()), pa.array([raw], pa.binary())], names=["cell", "ids", "codes", "raw"])

    assigned = rows.mapInArrow(coded, f"id {kind}, v array<double>, cell int, code binary")
    assigned.write.mode("overwrite").parquet(f"{path}/assigned")
    assigned = spark.read.schema(assigned.schema).parquet(f"{path}/assigned")
    # as many blocks as a cell's rows need
    blocks = assigned.groupBy("cell").agg(F.ceil(F.count("*") / p.block_rows).alias("parts"))
    dealt = assigned.join(blocks, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    dealt.groupBy("cell", "part").applyInArrow(packed, f"cell int, ids array<{kind}>, codes binary, raw binary").repartitionByRange("cell").write.mode("overwrite").parquet(f"{path}/blocks")


def load_ivf(spark: SparkSession, path: str) -> dict:
    """The blocks, and the model: cells and books, whose size ``Params`` sets."""
    row = spark.read.parquet(f"{path}/model").first()
    books = [np.frombuffer(b["raw"], "<f8").reshape(-1, b["b"] - b["a"]) for b in row["books"]]
    return {"model": Model(np.frombuffer(row["cells"], "<f8").reshape(-1, row["dim"]), books, [0, *(b["b"] for b in row["books"])]), "blocks": spark.read.parquet(f"{path}/blocks")}


def search(index: dict, queries: DataFrame, k: int = 30, probes: int = 40, refine: int = 4, line: int = 32768) -> DataFrame:
    """``qid, id, dense_score, dense_rank`` of ``queries (qid, vector)`` by cosine, among the rows of the nearest cells.

    Lines of questions meet columns of blocks, as many as the rows need; a question looks into those of a column's blocks whose cell
    it probes, and a column gives k of a question. Codes are put together to vectors, so that rough cosines are one product.
    """
    model, blocks = index["model"], index["blocks"]
    asked = _units(queries, "qid", "vector", wide=False).filter(F.size("v") == model.cells.shape[1])
    held = queries.sparkSession.sparkContext.broadcast(model)
    qkind, kind = asked.schema["id"].dataType.simpleString(), blocks.schema["ids"].dataType.elementType.simpleString()
    n, (many, rows) = asked.count(), blocks.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    lines, columns = max(1, -(-n // line), min(4, n // 512)), max(1, -(-rows // line), min(8, many))

    def scored(q: np.ndarray, v: np.ndarray, near: np.ndarray, by_id: np.ndarray):
        if refine * k >= len(v):
            return tiles.best(q @ v.T, by_id, k)
        # one whole product costs less than the vectors of pairs
        score, rough = q @ v.T, q.astype(np.float32) @ near.T
        score[rough < tiles.bound(rough, refine * k)[:, None]] = -np.inf
        return tiles.best(score, by_id, k)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, out = held.value, []
        blocks = [tuple(right[c][y] for c in ("cell", "ids", "codes", "raw")) for y in range(right.num_rows)]
        none = pa.array([], right["ids"].type.value_type)
        ids = pa.concat_arrays([none, *(b[1].values for b in blocks)])
        by_id = tiles.rank_of(ids)
        for x in range(left.num_rows):
            qids = left["ids"][x].values
            q = tiles.units(left["raw"][x].as_py(), len(qids), left["dim"][x].as_py())
            probed = np.zeros((len(q), len(own.cells)), bool)
            np.put_along_axis(probed, np.argsort(-(q @ own.cells.T), axis=1, kind="stable")[:, :probes], True, 1)
            begin, parts = 0, []
            for cell, names, codes, raw in blocks:
                v = np.frombuffer(raw.as_py(), "<f8").reshape(len(names), -1)
                code = np.frombuffer(codes.as_py(), np.uint8).reshape(len(v), -1)
                near = (own.cells[cell.as_py()] + np.concatenate([book[code[:, m]] for m, book in enumerate(own.books)], 1)).astype(np.float32)
                met, step = np.flatnonzero(probed[:, cell.as_py()]), max(1, (tiles.CELLS >> 1) // len(v))
                for at in range(0, len(met), step):
                    i, j, s = scored(q[met[at : at + step]], v, near, by_id[begin : begin + len(v)])
                    parts.append((met[at + i], j + begin, s))
                begin += len(v)
            if parts:
                parts = [tiles.first(*(np.concatenate([p[c] for p in parts]) for c in range(3)), by_id, k)]
            out.append(tiles.chosen(qids, ids, parts, "dense_score"))
        return pa.concat_tables(out) if out else tiles.chosen(pa.array([], left["ids"].type.value_type), none, [], "dense_score")

    dealt = blocks.withColumn("column", F.pmod(F.xxhash64("cell", F.element_at("ids", 1)), F.lit(columns)).cast("int"))
    met = tiles.meet(tiles.packed(asked, lines, "line"), lines, dealt, columns, run, f"qid {qkind}, id {kind}, dense_score double")
    return ranked(met, "dense_score", "dense_rank", k)
