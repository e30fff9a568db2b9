"""Learned factors against a decomposition in memory, and against the hashed words on the benchmark."""

import numpy as np
from pyspark.sql import functions as F

from quern.operators import evaluation, factors, retrieval
from quern.plans import retrieval as plans
from quern.sources.tables import saver

SF = "/root/testdata/sf0.01"


def test_factors_are_the_singular_vectors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    p = factors.Params(dim=6, buckets=256, rounds=25, skip=0)
    made = factors.train(docs, p=p, save=saver(spark))
    rows = [r.b for r in docs.select(factors._buckets(F.col("text"), p.buckets).alias("b")).collect()]
    dense = np.zeros((len(rows), p.buckets))
    for i, own in enumerate(rows):
        for b, n in zip(*np.unique(own, return_counts=True)):
            dense[i, b] = (1 + np.log(n)) * made.idf[b]
        dense[i] /= max(np.linalg.norm(dense[i]), 1e-300)
    df = np.array([sum(b in own for own in map(set, rows)) for b in range(p.buckets)])
    assert np.allclose(made.idf, np.where(df > 0, np.log((1 + len(rows)) / (1 + df)) + 1e-3, 0))
    _, values, right = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(made.values[:4], values[:4], rtol=1e-4) and np.allclose(made.values, values[:6], rtol=0.02) and made.residual < 0.02
    assert np.abs(made.vectors.T @ made.vectors - np.eye(6)).max() < 1e-12
    clear = [k for k in range(5) if values[k] - values[k + 1] > 0.03 and (k == 0 or values[k - 1] - values[k] > 0.03)]
    assert clear and all(abs(made.vectors[:, k] @ right[k]) > 0.99 for k in clear)
    shown = docs.select(factors.embedding(F.col("text"), made).alias("v")).collect()
    want = dense @ made.vectors
    assert np.allclose([r.v for r in shown], want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-300))


def test_odd_texts_are_zero_vectors(spark):
    texts = spark.createDataFrame([("pump valve gate",), ("valve gate",), ("pump pump belt",), ("pump " * 20_000,), (None,), ("",), ("漢字 the of",)], "text string")
    made = factors.train(texts, p=factors.Params(dim=2, buckets=64, skip=0))
    v = np.array([r.v for r in texts.select(factors.embedding(F.col("text"), made).alias("v")).collect()])
    assert np.isfinite(v).all() and (v[4:] == 0).all() and np.allclose(np.linalg.norm(v[:4], axis=1), 1)
    assert not factors.train(texts.limit(0), p=factors.Params(dim=2, buckets=64)).values.any()


def test_learned_leg_ranks_better_than_hashed_words(spark):
    docs, asked, relevant = spark.read.parquet(f"{SF}/documents.parquet"), plans._asked(spark, SF), saver(spark)(plans._relevant(spark, SF))
    made = factors.train(docs, save=saver(spark))
    assert made.residual < 0.02

    def ndcg(embed):
        vectors, questions = docs.select("doc_id", embed(F.col("text")).alias("v")), asked.select("qid", embed(F.col("text")).alias("vector"))
        ranking = retrieval.dense_topk(vectors, questions, 30, "doc_id", "v").withColumnRenamed("dense_rank", "place")
        return evaluation.ranking_metrics(asked, ranking, relevant).agg(F.avg("ndcg")).first()[0]

    assert ndcg(factors.LearnedEmbedder(made).documents) > ndcg(lambda t: retrieval.hashed_embedding(t, 64)) + 0.2
