"""Language ID: multinomial naive Bayes over hashed character n-grams.

``train`` counts the n-grams of at most ``max_docs_per_lang`` documents of each
language (a bounded sample, drawn by a hash of the id) and keeps one matrix of
log-probabilities, buckets x languages: its size is fixed by those two numbers and
checked. ``predict`` broadcasts the matrix and scores whole texts in numpy, batch by
batch: every n-gram gathers its bucket's row, and rows are summed by document.

Null texts and texts without a letter are ``und`` with score 0. Without a labelled
document everything is ``und``. Ties go to the language first in the alphabet.
Only id, text and (for training) lang are read, so other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import in_slices, mix64

#: Characters that are scored together; a longer text goes through in several pieces.
PIECE = 1 << 18
#: A letter by its Unicode category; numeric signs and combining marks are none.
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    alpha: float = 0.5
    max_docs_per_lang: int = 8_000
    #: The largest matrix that may be broadcast.
    max_model_mb: int = 256


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: float32, (buckets + 1, languages); the last row is 0, for positions without an n-gram.
    weights: np.ndarray
    prior: np.ndarray
    params: Params


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _slots(codes: np.ndarray, params: Params):
    """For each order the buckets of the n-grams that begin at each position."""
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, max(params.orders) + 1):
        if len(codes) < n:
            return
        rolled = rolled[: len(codes) - n + 1] * step + codes[n - 1 :] + np.uint64(n)
        if n in params.orders:
            yield (mix64(rolled) & np.uint64(params.buckets - 1)).astype(np.int32)


def _pieces(codes: np.ndarray, params: Params):
    over = max(params.orders) - 1
    for at in range(0, len(codes), PIECE):
        yield codes[at : at + PIECE + over], min(PIECE, len(codes) - at)


def _slots_of(codes: np.ndarray, params: Params):
    """As ``_slots`` over a text of any length, in pieces that overlap so that each n-gram counts once."""
    for piece, own in _pieces(codes, params):
        for slots in _slots(piece, params):
            yield slots[:own]


def train(docs: DataFrame, may_learn: Column, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}
    langs = tuple(sorted(sizes))
    if params.buckets * len(langs) * 4 > params.max_model_mb << 20:
        raise ValueError(f"{len(langs)} languages x {params.buckets} buckets pass {params.max_model_mb} MB")
    if not langs:
        return Model((), np.zeros((params.buckets + 1, 0), np.float32), np.zeros(0), params)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, params.max_docs_per_lang / sizes[k]))])
    drawn = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1_000_000)) < share[F.col(lang_col)] * 1_000_000
    number = {k: i for i, k in enumerate(langs)}

    def count(batches):
        held = np.zeros((len(langs), params.buckets), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for slots in _slots_of(_codes(text.as_py()), params):
                    held[number[lang]] += np.bincount(slots, minlength=params.buckets)
        k, b = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(held[k, b], pa.int64())], names=["k", "b", "n"])

    counted = rows.filter(drawn).select(lang_col, text_col).mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    n = np.full((params.buckets, len(langs)), params.alpha)
    n[counted["b"].to_numpy(), counted["k"].to_numpy()] += counted["n"].to_numpy()
    weights = np.zeros((params.buckets + 1, len(langs)), np.float32)
    weights[:-1] = np.log(n / n.sum(0))
    prior = np.array([sizes[k] for k in langs], float)
    return Model(langs, weights, np.log(prior / prior.sum()), params)


def loglik(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-probabilities (documents x languages) and numbers of n-grams."""
    out, n = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    columns = [np.ascontiguousarray(model.weights[:, k]) for k in range(len(model.langs))]

    def add(first: int, codes: list[np.ndarray]) -> None:
        ends = np.cumsum([len(x) for x in codes])
        starts, codes = np.concatenate(([0], ends[:-1])), np.concatenate(codes)
        for order, slots in zip(sorted(model.params.orders), _slots(codes, model.params)):
            for back in range(1, order):  # windows that reach into the next text
                slots[(ends - back)[ends - back < len(slots)]] = model.params.buckets
            n[first : first + len(ends)] += np.maximum(0, ends - starts - order + 1)
            for k, column in enumerate(columns):
                out[first : first + len(ends), k] += np.add.reduceat(column[slots].astype(np.float64), np.minimum(starts, len(slots) - 1)) if len(slots) else 0

    held: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        codes = _codes(text)
        if len(codes) > PIECE:
            for slots in _slots_of(codes, model.params):
                n[i] += len(slots)
                for k, column in enumerate(columns):
                    out[i, k] += column[slots].sum(dtype=np.float64)
            codes = None
        if held and (codes is None or size + len(codes) > PIECE):
            add(i - len(held), held)
            held, size = [], 0
        if codes is not None:
            held.append(codes)
            size += len(codes)
    if held:
        add(len(texts) - len(held), held)
    return out, n


def score_texts(texts: list[str | None], model: Model, full_at: float = 60.0) -> tuple[list[str], np.ndarray]:
    """Languages and scores. n-grams overlap, so a text counts as ``full_at`` independent ones at most."""
    texts = ["" if x is None else x for x in texts]
    real = np.array([bool(_LETTER.search(x)) for x in texts], bool)
    if not model.langs or not len(texts):
        return ["und"] * len(texts), np.zeros(len(texts))
    total, n = loglik(texts, model)
    z = total * np.minimum(1, full_at / np.maximum(n, 1))[:, None] + model.prior
    z -= z.max(1, keepdims=True)
    best = (total + model.prior).argmax(1)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    return [model.langs[k] if r else "und" for k, r in zip(best, real)], np.where(real, p[np.arange(len(texts)), best], 0.0)


def predict(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for part in in_slices(batches, 500):
            langs, scores = score_texts(part.column(1).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_known(spark: SparkSession, docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of ``least`` or more.

    Only the texts go to Python and only a mask comes back, so nothing is shuffled.
    """
    held = spark.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches):
        for part in in_slices(batches, 500):
            langs, scores = score_texts(part.column(at).to_pylist(), held.value)
            yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
