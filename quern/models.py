"""The models that a user may bring, as protocols, and the offline substitutes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

from pyspark.sql import Column

from quern.functions import text as T
from quern.operators import retrieval


class Embedder(Protocol):
    """Columns of texts to columns of unit vectors, ``array<double>``: built-in expressions or a pandas UDF with a model in each worker."""

    name: str
    dim: int

    def documents(self, text: Column) -> Column: ...

    def queries(self, text: Column) -> Column: ...


class Scorer(Protocol):
    """The relevance of a text to a question; larger is better."""

    def score(self, query: Column, text: Column) -> Column: ...


TokenCounter = Callable[[Column], Column]


class Answerer(Protocol):
    """A language model: the tokens of an answer to ``messages`` (role, content)."""

    def stream(self, messages: list[dict], max_tokens: int, temperature: float) -> Iterator[str]: ...


@dataclass(frozen=True)
class HashedEmbedder:
    """Content words hashed with signs; ``prefix`` stands before a question, as instruction-tuned models want it."""

    dim: int = 64
    prefix: str = ""

    @property
    def name(self) -> str:
        return f"hashed-{self.dim}"

    def documents(self, text: Column) -> Column:
        return retrieval.hashed_embedding(text, self.dim)

    def queries(self, text: Column) -> Column:
        from pyspark.sql import functions as F

        return self.documents(F.concat(F.lit(self.prefix), text))


class CoverageScorer:
    """The share of the question's words that the text has."""

    def score(self, query: Column, text: Column) -> Column:
        return T.overlap(T.content_words(query), T.content_words(text))


class ExtractiveAnswerer:
    """The first sentence of each block of the fenced context, with its citation."""

    def stream(self, messages: list[dict], max_tokens: int, temperature: float) -> Iterator[str]:
        system = messages[0]["content"]
        blocks = system.split("<<<SOURCE_DATA\n", 1)[-1].split("### [")[1:] if "<<<SOURCE_DATA" in system else []
        said = [f"{body[2].split('. ')[0].strip().rstrip('.')} [{head.split(']')[0]}]." for head in blocks if len(body := head.split("\n", 2)) > 2]
        words = (" ".join(said) or "Hello. Ask about the documents.").split(" ")
        for k, word in enumerate(words[:max_tokens]):
            yield word if k == 0 else f" {word}"


ANSWERERS: dict[str, Callable[[], Answerer]] = {"extractive": ExtractiveAnswerer}


@lru_cache
def answerer(name: str) -> Answerer:
    """The backend of that name, made once; a user adds one to ANSWERERS."""
    if name not in ANSWERERS:
        raise ValueError(f"no answerer {name!r}: {', '.join(sorted(ANSWERERS))}")
    return ANSWERERS[name]()


@dataclass(frozen=True)
class Models:
    embedder: Embedder = HashedEmbedder()
    scorer: Scorer = CoverageScorer()
    count: TokenCounter = T.count_tokens
    answerer: Answerer | None = None
