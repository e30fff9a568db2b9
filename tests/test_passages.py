"""The passage scorer against every stretch of a text, its fit against its own conditions, and its order on held-out questions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.text import STOP_WORDS
from quern.models import CoverageScorer
from quern.operators import evaluation, passages
from quern.operators import retrieval as operators
from quern.plans import passages as plans
from quern.plans import retrieval
from quern.sources.tables import saver

SF = "/root/testdata/sf0.01"


def cut(text):
    return [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in STOP_WORDS]


def brute(question, text):
    """Every stretch from every place, the shortest first and then the first."""
    asked, words = list(dict.fromkeys(cut(question))), cut(text)
    held = [w for w in asked if w in words]
    if not held:
        return 0.0, 0.0, 0.0
    spans = ((b - a + 1, b, a) for b in range(len(words)) for a in range(b + 1) if set(held) <= set(words[a : b + 1]))
    width, b, a = min(spans)
    last = [max(i for i in range(a, b + 1) if words[i] == w) for w in held]
    forward = sum(x < y for x, y in zip(last, last[1:]))
    return len(held) / len(asked), len(held) / width, forward / (len(asked) - 1) if len(held) > 1 else 0.0


def test_features_are_those_of_the_least_stretch(spark):
    r = random.Random(5)
    words = "pump valve gate fan belt the of 29 mask".split()
    text = lambda n: " ".join(r.choice(words) + r.choice(["", ".", ",", "\n"]) for _ in range(n))
    rows = [(k, text(r.randrange(1, 8)), text(r.randrange(0, 40))) for k in range(150)]
    rows += [(150, None, "pump"), (151, "pump", None), (152, "", ""), (153, "the of", "the of"), (154, "Pump pump", "a PUMP"), (155, "pump belt", "漢字 " * 500 + "belt pump")]
    df = spark.createDataFrame(rows, "k int, q string, t string")
    got = {x.k: tuple(x.f) for x in df.select("k", passages.features(F.col("q"), F.col("t")).alias("f")).collect()}
    assert all(got[k] == pytest.approx(brute(q, t), abs=1e-12) for k, q, t in rows)
    assert {got[k] for k in (150, 151, 152, 153)} == {(0.0, 0.0, 0.0)} and got[154] == (1.0, 1.0, 0.0) and got[155] == (1.0, 1.0, 0.0)
    w = passages.Weights()
    score = df.filter("k = 154").select(passages.PassageScorer().score(F.col("q"), F.col("t"))).first()[0]
    assert score == pytest.approx(1 / (1 + np.exp(-(w.bias + w.coverage + w.density))))


def test_long_text(spark):
    df = spark.createDataFrame([("pump belt valve", "pump gate " * 30_000 + "valve belt pump")], "q string, t string")
    assert tuple(df.select(passages.features(F.col("q"), F.col("t")).alias("f")).first().f) == (1.0, 1.0, 0.0)


def test_fit_is_the_least_loss(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    y = rng.random(400) < 1 / (1 + np.exp(-(x @ [3.0, 1.0, -2.0] - 1)))
    rows = [(*map(float, v), bool(b)) for v, b in zip(x, y)] + [(None, 0.1, 0.1, True), (0.1, 0.1, 0.1, None)]
    judged = spark.createDataFrame(rows, "coverage double, density double, `order` double, relevant boolean")
    p = passages.Params()
    w = passages.fit(judged, p)
    v = np.array([w.bias, w.coverage, w.density, w.order])
    one = np.c_[np.ones(400), x]
    q = 1 / (1 + np.exp(-one @ v))
    assert np.abs(one.T @ (q - y) + p.ridge * np.r_[0.0, v[1:]]).max() < 1e-6  # where the loss is flat
    # nothing to learn from: the given weights
    assert passages.fit(judged.filter("relevant")) == passages.fit(judged.limit(0)) == passages.Weights()
    # kinds that a feature tells apart completely have finite weights
    apart = passages.fit(spark.createDataFrame([(1.0, 0.0, 0.0, True), (0.0, 0.0, 0.0, False)] * 5, judged.schema))
    assert np.isfinite([apart.bias, apart.coverage, apart.density, apart.order]).all() and apart.coverage > 1


def test_rescored_keeps_ties_in_their_first_order(spark):
    rows = [(1, 5, 2, 1.0, 1.0, 1.0), (1, 9, 1, 1.0, 1.0, 1.0), (1, 4, 3, 0.5, 0.1, 0.0), (2, 4, 1, 0.0, 0.0, 0.0)]
    pool = spark.createDataFrame(rows, "qid int, id int, sparse_rank int, coverage double, density double, `order` double")
    got = [(r.qid, r.id, r.place) for r in passages.rescored(pool, passages.Weights(), 2).orderBy("qid", "place").collect()]
    assert got == [(1, 9, 1), (1, 5, 2), (2, 4, 1)]


def compared(spark, docs, index):
    """Mean ndcg of held-out short questions by the fitted scorer and by coverage alone."""
    save = saver(spark)
    asked, relevant = plans.short_questions(spark, SF), save(retrieval._relevant(spark, SF))
    pairs = save(plans.judged(asked, docs, index, relevant))
    held = pairs.filter("held_out")
    assert held.count() > 100 and pairs.filter("not held_out").count() > 100

    def ndcg(weights):
        ranking = passages.rescored(held, weights, plans.POOL)
        return evaluation.ranking_metrics(asked.filter("held_out"), ranking, relevant).agg(F.avg("ndcg")).first()[0]

    # the coverage of the offline scorer is this feature
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    plain = held.join(texts, "id").join(asked, "qid").select(F.abs(CoverageScorer().score(F.col("text"), F.col("body")) - F.col("coverage")).alias("off"))
    assert plain.agg(F.max("off")).first()[0] < 1e-12
    out = ndcg(passages.fit(pairs.filter("not held_out"))), ndcg(passages.Weights(0.0, 1.0, 0.0, 0.0))
    print("held-out ndcg, fitted and coverage:", *out)
    return out


def test_fitted_order_is_no_worse_than_coverage_on_the_documents(spark):
    fitted, coverage = compared(spark, spark.read.parquet(f"{SF}/documents.parquet"), retrieval._index(spark, SF))
    assert fitted >= coverage > 0.9


def test_fitted_order_tells_passages_from_the_same_words_in_another_order(spark):
    """Each document that holds an item has a double with its words sorted, which coverage and BM25 can't tell from it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    right = saver(spark)(retrieval._relevant(spark, SF).select(F.col("id").alias("doc_id")).distinct())
    number = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id") + 10**9)
    doubles = docs.join(right, "doc_id").select(number.alias("doc_id"), F.array_join(F.array_sort(F.split("text", " ")), " ").alias("text"))
    whole = saver(spark)(docs.unionByName(doubles))
    fitted, coverage = compared(spark, whole, {k: saver(spark)(v) for k, v in operators.bm25_index(whole).items()})
    assert fitted > coverage + 0.1
