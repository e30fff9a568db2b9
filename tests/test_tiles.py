"""Searches in tiles: the best of a matrix, what is sent, vectors that have no cosine."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import chunking, cleaning, factors, ivf, retrieval, tiles
from quern.plans import passages
from quern.sources import segments


@pytest.mark.parametrize("rows,columns,k", [(3, 5, 7), (4, 900, 3), (5, 4000, 30), (2, 64, 64)])
def test_best_of_a_matrix_with_ties(rows, columns, k):
    draw = np.random.default_rng(rows)
    score = np.round(draw.normal(size=(rows, columns)), 1)
    ids = draw.permutation(columns)
    i, j, s = tiles.best(score, tiles.rank_of(pa.array(ids)), k)
    want = [(r, ids[c]) for r in range(rows) for c in sorted(range(columns), key=lambda c: (-score[r, c], ids[c]))[:k]]
    assert list(zip(i, ids[j])) == want and (s == score[i, j]).all()
    i, j, s = tiles.best(score, tiles.rank_of(pa.array(ids)), k, 0.0)
    assert (s > 0).all() and len(i) == sum(min(k, (x > 0).sum()) for x in score)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_sends_postings_and_no_scores_of_pairs(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("fox"), F.col("id").cast("string"), F.lit("hat")).alias("text"))
    asked = spark.createDataFrame([(1, "fox 7 fox"), (2, "the hat"), (3, "absent"), (4, None)], "qid long, text string")
    found = retrieval.bm25_topk(docs, asked, 3)
    assert not re.search(r"hashpartitioning\(qid#\d+L?, id#", plan(found))
    assert [(r.qid, r.id) for r in found.orderBy("qid", "sparse_rank").collect()] == [(1, 7), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_bm25_of_no_documents_and_repeated_ids(spark):
    asked = spark.createDataFrame([(1, "fox")], "qid long, text string")
    assert retrieval.bm25_topk(spark.createDataFrame([], "doc_id long, text string"), asked).count() == 0
    twice = spark.createDataFrame([("a", "fox"), ("a", "fox hat"), ("b", "hat")], "doc_id string, text string")
    assert [r.id for r in retrieval.bm25_topk(twice, asked).collect()] == ["a"]


def test_a_vector_without_a_cosine_hides_no_other(spark):
    rows = [(n, [float(n), 1.0]) for n in range(40)] + [(40, [float("nan"), 1.0]), (41, [None, 1.0]), (42, None), (43, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.filter("vec_id in (3, 40, 43)").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    found = retrieval.dense_topk(vectors, asked, 2)
    assert [(r.qid, r.id) for r in found.orderBy("qid", "dense_rank").collect()] == [(3, 3), (3, 4), (43, 43)]


def test_cells_send_no_question_to_each_cell(spark, tmp_path):
    draw = np.random.default_rng(2)
    vectors = spark.createDataFrame([(n, draw.normal(size=8).tolist()) for n in range(300)], "vec_id long, embedding array<float>")
    ivf.write_ivf(vectors, f"{tmp_path}/cells", ivf.Params(cells=8))
    asked = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    found = ivf.search(ivf.load_ivf(spark, f"{tmp_path}/cells"), asked, 5, probes=8, refine=1000)
    assert "Join" not in plan(found)
    key = ["qid", "id", "dense_rank"]
    assert found.select(key).exceptAll(retrieval.dense_topk(vectors, asked, 5).select(key)).count() == 0 and found.count() == 1500


def test_blocks_of_pages_come_in_small_parts(spark):
    pages = spark.range(2500).select(F.col("id").alias("page_id"), F.when(F.col("id") % 50 != 0, F.concat(F.lit("<p>a"), "id", F.lit("</p><p>b</p>"))).alias("html"))
    found = cleaning.html_blocks(pages.coalesce(1), "page_id", "html")
    assert "MapInArrow" in plan(found)
    rows = [(r.id, r.block, r.text) for r in found.orderBy("id", "block").collect()]
    assert rows == [x for n in range(2500) if n % 50 for x in ((n, 0, f"a{n}"), (n, 1, "b"))]


def test_long_folds_over_few_bytes_are_dealt_over_cores(spark):
    docs = spark.createDataFrame([(n, f"fox {n} hat") for n in range(6)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fox hat")], "qid long, text string")
    pairs = spark.createDataFrame([(1, 2, 1)], "qid long, id long, sparse_rank int")
    pool = docs.select(F.lit(1).alias("qid"), F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.lit("s").alias("section"), F.lit(0.5).alias("relevance"), F.array(F.lit(1.0)).alias("vector"))
    hits = docs.select(F.lit(1).alias("qid"), F.col("doc_id").alias("place"), F.col("doc_id").cast("string").alias("section"), F.lit("h").alias("heading"), F.lit("p").alias("path"), F.lit("s").alias("source"), F.col("text").alias("body"))
    for df in (passages.scored(pairs, asked, docs), retrieval.mmr(pool), chunking.assemble(hits)):
        assert "REPARTITION_BY_NUM" in plan(df) and df.count() > 0


def test_words_of_a_segment_are_counted_in_place(spark):
    new = spark.createDataFrame([(1, "fox hat fox", "h"), (2, "", "i"), (3, "The hat", "j")], "id long, text string, hash string")
    made = segments._counted(new, lambda text: F.array(F.length(text).cast("double")), "bigint", False)
    assert "Exchange" not in plan(made)
    assert [(r.id, r.hash, r.vector, r.dl, r.counts) for r in made.orderBy("id").collect()] == [(1, "h", [11.0], 3, {"fox": 2, "hat": 1}), (2, "i", [0.0], 0, {}), (3, "j", [7.0], 1, {"hat": 1})]


def test_entries_of_lists_are_counted():
    row, col, n = factors._entries(pa.array([[5, 2, 5], [], None, [5]], pa.list_(pa.int32())), 8)
    assert (row.tolist(), col.tolist(), n.tolist()) == ([0, 0, 3], [2, 5, 5], [1, 2, 1])


def test_words_of_an_index_are_counted_in_place(spark):
    docs = spark.createDataFrame([(1, "fox hat fox"), (2, None), (3, "the"), (4, "Hat")], "doc_id long, text string")
    held = retrieval.bm25_index(docs)
    assert "Exchange" not in plan(held["postings"])
    assert sorted(map(tuple, held["postings"].collect())) == [(1, "fox", 2, 3), (1, "hat", 1, 3), (4, "hat", 1, 1)]
    assert tuple(held["stats"].first()) == (4, 1.0)
    twice = retrieval.bm25_index(spark.createDataFrame([(1, "fox hat"), (1, "fox"), (2, "fox")], "doc_id long, text string"))
    assert sorted(map(tuple, twice["postings"].collect())) == [(1, "fox", 2, 2), (1, "hat", 1, 2), (2, "fox", 1, 1)]
    assert sorted(map(tuple, twice["terms"].collect())) == [("fox", 2), ("hat", 1)]


def test_long_rows_that_no_join_wants_stay(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text")).unionByName(spark.createDataFrame([(None, "y")], "doc_id long, text string"))
    wanted = spark.createDataFrame([(7,), (7,), (900,), (-1,)], "id long")
    kept = retrieval.some(docs, "doc_id", wanted, "id")
    assert kept.columns == ["doc_id", "text"] and sorted(r.doc_id for r in kept.collect()) == [7, 900]
    assert not re.search(r"hashpartitioning\(doc_id#", plan(kept)) and retrieval.some(docs, "doc_id", wanted.limit(0), "id").count() == 0
