"""A corpus from documents to tokens: five stages, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before kept. All but the last return the columns of ``docs``; repeated documents are
rows of their own. Texts that a stage changes have a new ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, langid, minhash, mixing, pii
from quern.llm.common import Scratch, table
from quern.llm.queries import pii_key, remainder, vocabulary


#: Tables that stages wrote for themselves; ``run`` deletes them once their stage is written.
_HELD: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    _HELD.append(Scratch(spark, name))
    return _HELD[-1]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is in doubt."""
    model = langid.train(docs, remainder("doc_id", 3) != 1)
    return langid.keep_known(spark, docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return minhash.keep_one(docs, _scratch(spark, "near"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates."""
    out = pii.replace(docs, _scratch(spark, "pii"), pii_key(spark))
    size = F.when(F.size(out.columns[-1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats small sources toward equal weights, at most twice; every document is given at least once."""
    return mixing.mixed_documents(docs, _scratch(spark, "mix"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, *vocabulary(), with_ids=True)


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("private", private), ("mixture", mixed), ("tokens", encoded)]

#: SQL expresses neither the learned languages nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    scratch, last = Scratch(spark, "pipeline"), None
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        while _HELD:
            _HELD.pop().clear()
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
