"""A scorer of texts by passages: how much of a question a text has, how close together, and in which order.

``features`` are columns of one question and one whole text, so nothing is shuffled and no Python runs; the
words' places in the text are the postings. Stop words count neither as words nor as places. ``fit``
learns weights from judged pairs by Newton's method: each step is one aggregate of 14 sums over all
pairs, so there is no bound on them and nothing but the sums reaches the driver.

A null or empty question or text has 0 in all features. A text without any word of the question has 0 in
all. Repeated words of a question count once, at their first place. A question of one word has order 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

FEATURES = ("coverage", "density", "order")


def _least_span(wanted: Column, words: Column) -> Column:
    """``struct<at, width>``: the places of the ``wanted`` in the first of the least stretches of ``words`` with all of them.

    A fold over the places of wanted words, which keeps each one's last place.
    """
    places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), (F.array_position(wanted, w) - 1).alias("k"))), lambda p: p["k"] >= 0)
    none = F.transform(wanted, lambda w: F.lit(-1))
    zero = F.struct(none.alias("last"), none.alias("at"), F.lit(2**31 - 1).alias("width"))

    def step(held, p):
        last = F.transform(held["last"], lambda v, k: F.when(k == p["k"], p["i"]).otherwise(v))

        def better(x):
            first = F.array_min(x)
            width = p["i"] - first + 1
            less = (first >= 0) & (width < held["width"])
            return F.struct(x.alias("last"), F.when(less, x).otherwise(held["at"]).alias("at"), F.when(less, width).otherwise(held["width"]).alias("width"))

        # a variable of a lambda is evaluated once
        return F.transform(F.array(last), better)[0]

    return F.aggregate(places, zero, step, lambda held: F.struct(held["at"].alias("at"), held["width"].alias("width")))


def features(question: Column, text: Column) -> Column:
    """``struct<coverage, density, order>``, all from 0 to 1.

    coverage: share of the question's distinct words that the text has; density: their number by the
    number of words in the least stretch of the text that has them all; order: the share of the question's steps from one
    word to the next (of those the text has) that go forward in that stretch.
    """
    asked, words = F.array_distinct(T.content_words(F.coalesce(question, F.lit("")))), T.content_words(F.coalesce(text, F.lit("")))

    def of_terms(x):
        # in the order of the question
        return F.struct(F.size(x["asked"]).alias("n"), F.array_intersect(x["asked"], x["words"]).alias("held"), x["words"].alias("words"))

    def of_places(x):
        return F.struct(x["n"].alias("n"), F.size(x["held"]).alias("m"), _least_span(x["held"], x["words"]).alias("best"))

    def shares(y):
        at = y["best"]["at"]
        forward = F.size(F.filter(F.transform(at, lambda v, k: (k > 0) & (F.get(at, k - 1) < v)), lambda b: b))
        share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))
        density = F.when(y["m"] > 0, share(y["m"], y["best"]["width"])).otherwise(0.0)
        order = F.when(y["m"] > 1, share(forward, y["n"] - 1)).otherwise(0.0)
        return F.struct(share(y["m"], y["n"]).alias("coverage"), density.alias("density"), order.alias("order"))

    one = F.array(F.struct(asked.alias("asked"), words.alias("words")))
    # variables of lambdas, unlike columns, are evaluated once
    return F.transform(F.transform(F.transform(one, of_terms), of_places), shares)[0]


@dataclass(frozen=True)
class Weights:
    """Log odds that a text answers: ``bias`` and a weight for each of FEATURES."""

    bias: float = -8.0
    coverage: float = 6.0
    density: float = 4.0
    order: float = 2.0

    def of(self, f: Column) -> Column:
        z = F.lit(self.bias)
        for name in FEATURES:
            z = z + getattr(self, name) * f[name]
        return 1 / (1 + F.exp(-z))


@dataclass(frozen=True)
class PassageScorer:
    """A scorer for ``quern.models.Models``: the probability that the text answers the question."""

    weights: Weights = Weights()

    def score(self, query: Column, text: Column) -> Column:
        return F.transform(F.array(features(query, text)), self.weights.of)[0]


@dataclass(frozen=True)
class Params:
    """``ridge`` holds the weights (not the bias) near 0; a fit ends when no weight moves by ``tolerance``, after ``steps`` at most."""

    ridge: float = 1e-2
    tolerance: float = 1e-8
    steps: int = 40


def fit(judged: DataFrame, p: Params = Params()) -> Weights:
    """Weights from ``judged``: FEATURES and ``relevant`` boolean, which is read once a step and should be a written table.

    Rows with a null in any of them take no part. Without rows of both kinds the weights are the given defaults.
    """
    known = judged.select(*FEATURES, F.col("relevant").cast("double").alias("y")).na.drop()
    n, right = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not 0 < right < n:
        return Weights()
    x = [F.lit(1.0), *(F.col(f) for f in FEATURES)]
    ridge = p.ridge * np.diag([0.0] + [1.0] * len(FEATURES))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """What is made least, its gradient and its curvature."""
        z = sum((float(v) * c for v, c in zip(w, x)), F.lit(0.0))
        q = 1 / (1 + F.exp(-F.col("z")))
        # log(1 + exp z) without overflow
        loss = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("y") * F.col("z")
        row = known.withColumn("z", z).agg(F.sum(loss), *[F.sum((q - F.col("y")) * c) for c in x], *[F.sum(q * (1 - q) * x[i] * x[j]) for i, j in pairs]).first()
        curve = np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, row[1 + len(x) :]):
            curve[i, j] = curve[j, i] = v
        return row[0] + w @ ridge @ w / 2, np.array(row[1 : 1 + len(x)]) + ridge @ w, curve + ridge

    w = np.array([np.log(right / (n - right))] + [0.0] * len(FEATURES))
    value, slope, curve = sums(w)
    for _ in range(p.steps):
        move, size = np.linalg.lstsq(curve, slope, rcond=None)[0], 1.0
        while True:  # shorter while it does not go down
            tried = w - size * move
            reached = sums(tried)
            if reached[0] <= value or size < 1e-6:
                break
            size /= 2
        w, (value, slope, curve) = tried, reached
        if np.abs(size * move).max() < p.tolerance:
            break
    return Weights(*map(float, w))


def rescored(candidates: DataFrame, weights: Weights, k: int) -> DataFrame:
    """``qid, id, score, place`` of the best ``k`` of ``candidates (qid, id, FEATURES, sparse_rank)``; ties in their first order."""
    from quern.operators.retrieval import PLACES, ranked

    scored = candidates.select("qid", "id", weights.of(F.struct(*FEATURES)).alias("score"), "sparse_rank")
    tied = scored.withColumn("score", F.round("score", PLACES))
    best = ranked(tied.withColumn("id", F.struct("sparse_rank", "id")), "score", "place", k)
    return best.select("qid", F.col("id.id").alias("id"), "score", "place")
