"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

``features`` turns whole texts into transformed statistics (logs of counts, square
roots of shares). ``fit`` takes at most ``max_rows`` labelled documents (a bounded
sample, drawn by a hash of the id), estimates a mean and a covariance for each class,
shrinks the covariance toward the pooled one and a multiple of the identity, and
keeps Cholesky factors. A score is the logistic of the difference of the Gaussian
log-densities plus the log-odds of the classes.

Null texts count as empty; empty texts get a score as all others. With a single class
or none among the labels the score is the smoothed share of label 1 for every text.
Labels that are null or not 0/1 and rows without an id are not learned from. The
score reads the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import shingles
from quern.llm.common import in_slices, utf8


@dataclass(frozen=True)
class Params:
    max_rows: int = 12_000
    #: Shares of the pooled covariance and of the identity in each class's covariance.
    to_pooled: float = 0.1
    to_identity: float = 0.02


@dataclass(frozen=True)
class Model:
    center: np.ndarray
    spread: np.ndarray
    means: tuple
    factors: tuple
    log_dets: tuple
    log_odds: float


NAMES = ("chars", "words", "word_length", "word_length_sd", "upper", "digit", "space", "punct", "odd", "pipe", "comma_stop", "non_ascii", "lines", "line_length", "line_repeat", "word_repeat", "pair_repeat", "run_repeat", "capital_words", "end_stops")

_KIND = np.zeros((8, 256), np.int64)
for _k, _set in enumerate((range(65, 91), range(48, 58), (32, *range(9, 14)), (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)), b"#$%&*@^~<>{}[]\\!", b"|", b",.;:", range(128, 192))):
    _KIND[_k, list(_set)] = 1


def _repeat(items: np.ndarray) -> float:
    return 1 - len(np.unique(items)) / len(items) if len(items) else 0.0


def statistics(data: np.ndarray) -> np.ndarray:
    """The transformed statistics of one text (UTF-8 bytes)."""
    counts = np.zeros(256, np.int64)
    for at in range(0, len(data), 1 << 22):
        counts += np.bincount(data[at : at + (1 << 22)], minlength=256)
    upper, digit, space, punct, odd, pipe, comma, tail = _KIND @ counts
    n = len(data) - tail
    hashes, starts = shingles.words(data), shingles.starts(data)
    w, letters = len(hashes), n - space
    breaks = np.flatnonzero(data == 10)
    lengths = np.diff(np.concatenate((starts, [len(data)]))) if w else np.zeros(1)
    line_of = np.searchsorted(breaks, starts)
    first = np.concatenate(([True], line_of[1:] != line_of[:-1])) if w else np.zeros(0, bool)
    # a line's key is the sum of its words' hashes
    lines = np.add.reduceat(hashes, np.flatnonzero(first)) if w else hashes
    caps = int(((data[starts] >= 65) & (data[starts] <= 90)).sum()) if w else 0
    stops = int((data[starts[1:] - 2] == 46).sum()) if w > 1 else 0
    share = lambda x, y: np.sqrt(x / max(y, 1))
    return np.array([
        np.log1p(n), np.log1p(w), np.log1p(letters / max(w, 1)), np.log1p(lengths.std()),
        share(upper, n), share(digit, n), share(space, n), share(punct, n), share(odd, n), share(pipe, n), share(comma, n), share(tail, n),
        np.log1p(len(breaks)), np.log1p(w / max(len(lines), 1)),
        np.sqrt(_repeat(lines)), np.sqrt(_repeat(hashes)), np.sqrt(_repeat(shingles.shingle(hashes, 2))), np.sqrt(_repeat(shingles.shingle(hashes, 8))),
        share(caps, w), share(stops, w),
    ])


def features(column: pa.Array) -> np.ndarray:
    data, off = utf8(column)
    return np.array([statistics(data[a:b]) for a, b in zip(off[:-1], off[1:])]).reshape(-1, len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(may_learn & F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    n = rows.count()
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, params.max_rows / max(n, 1)))

    def run(batches):
        for batch in in_slices(batches):
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    # at most about max_rows ids: a bounded broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select("text", "y").mapInArrow(run, "x array<double>, y int").toArrow()
    y = sample["y"].to_numpy()
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    odds = float(np.log((ones + 0.5) / (zeros + 0.5)))
    p = len(NAMES)
    if min(ones, zeros) < 2:
        flat = np.eye(p)
        return Model(np.zeros(p), np.ones(p), (np.zeros(p),) * 2, (flat,) * 2, (0.0,) * 2, odds)
    x = np.array(sample["x"].to_pylist())
    center, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - center) / spread
    means = tuple(z[y == k].mean(0) for k in (0, 1))
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = (zeros * own[0] + ones * own[1]) / len(y)
    factors, dets = [], []
    for cov in own:
        cov = (1 - params.to_pooled) * cov + params.to_pooled * pooled
        cov = (1 - params.to_identity) * cov + params.to_identity * np.trace(cov) / p * np.eye(p) + 1e-6 * np.eye(p)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        dets.append(2 * float(np.log(np.diag(lower)).sum()))
    return Model(center, spread, means, tuple(factors), tuple(dets), odds)


def score(x: np.ndarray, model: Model) -> np.ndarray:
    z = (x - model.center) / model.spread
    log = []
    for mean, inverse, det in zip(model.means, model.factors, model.log_dets):
        far = (z - mean) @ inverse.T
        log.append(-0.5 * ((far * far).sum(1) + det))
    return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + model.log_odds, -700, 700)))


def predict(spark: SparkSession, docs: DataFrame, model: Model, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row; the model's size is fixed by the statistics."""
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in in_slices(batches):
            s = score(features(batch.column(1)), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= least).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
