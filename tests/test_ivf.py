"""The inverted file against all cosines."""

import numpy as np
from pyspark.sql import functions as F

from quern.operators import ivf

SF = "/root/testdata/sf0.01"


def brute(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)
    x = unit(x)
    return {q: ids[np.lexsort((ids, -np.round(x @ unit(np.array(v, float)), 10)))[:k]].tolist() for q, v in asked}


def found(out):
    got = {}
    for r in out.collect():
        got.setdefault(r.qid, {})[r.dense_rank] = r.id
    return {q: [own[n] for n in sorted(own)] for q, own in got.items()}


def recall(got, want):
    return np.mean([len(set(got.get(q, [])) & set(w)) / len(w) for q, w in want.items()])


def made(spark, tmp_path, rows, p=ivf.Params()):
    ivf.write_ivf(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")), str(tmp_path), p)
    return ivf.load_ivf(spark, str(tmp_path))


def asking(spark, rows):
    return spark.createDataFrame(rows, "qid long, vector array<double>")


def test_recall_on_the_embeddings(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    ivf.write_ivf(vectors, str(tmp_path))
    got = found(ivf.search(ivf.load_ivf(spark, str(tmp_path)), vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))))
    assert recall(got, brute(rows, rows, 30)) >= 0.9


def test_few_cells_are_enough_where_vectors_lie_in_groups(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + 0.25 * rng.normal(size=32)).tolist()) for i in range(2000)]
    asked = rows[::20]
    got = found(ivf.search(made(spark, tmp_path, rows), asking(spark, asked), 10, probes=4))
    assert recall(got, brute(rows, asked, 10)) >= 0.95


def test_exact_with_all_cells_and_candidates(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 10))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[7].tolist()) for i in range(150)]  # a third of all rows are equal
    rows += [(5, x[9].tolist()), (2000, [0.0] * 10)]
    odd = [(3000, None), (3001, []), (3002, [1.0]), (3003, [float("nan")] * 10), (3004, [None] * 10), (3005, [float("inf")] * 10)]
    index = made(spark, tmp_path, rows + odd, ivf.Params(cells=8, block_rows=40, stretches=3))
    assert index["blocks"].agg(F.max(F.size("ids"))).first()[0] < 120
    asked = [(i, v) for i, v in rows[::7]]
    got = found(ivf.search(index, asking(spark, asked + odd), 12, probes=8, refine=100))
    want = brute(rows, asked, 12)
    assert got == want


def test_of_nothing(spark, tmp_path):
    index = made(spark, tmp_path, [])
    assert ivf.search(index, asking(spark, [(1, [1.0])])).count() == 0
    one = made(spark, tmp_path / "one", [(4, [1.0, 2.0, 3.0])])
    assert found(ivf.search(one, asking(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0])]))) == {1: [4]} and ivf.search(one, asking(spark, []).limit(0)).count() == 0
