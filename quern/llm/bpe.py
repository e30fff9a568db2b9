"""Byte-level BPE over Arrow batches with the tokenizers library.

A byte-level vocabulary writes each of the 256 bytes as one visible character.
Texts are split by the vocabulary's pattern, every piece is encoded by the library
on its own (so a piece seen before comes from a bounded memo of the worker), and ids
come with byte and character offsets. Decoding reverses the byte table; a character
whose bytes are split between tokens is only whole once the bytes are joined.

Null text counts as empty: no ids, empty bytes. Ids outside the vocabulary raise.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import in_slices

#: Pieces that a worker remembers in each of two generations.
MEMO_PIECES = 120_000


def byte_characters() -> dict[int, str]:
    """The visible character of each byte: printable Latin-1 stands for itself, the rest are dealt from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Piece -> its ids as little-endian uint32 bytes. When full, it becomes the older generation; pieces in use come back from there."""

    def __init__(self, codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = np.asarray(self.codec.model.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """One vocabulary in one Python process."""

    def __init__(self, vocabulary: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        if vocabulary.endswith(".tiktoken"):
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
            shown = byte_characters()
            names = {"".join(map(shown.__getitem__, raw)): i for raw, i in ranks.items()}
            self.model = Tokenizer(models.BPE(vocab=names, merges=_merges(ranks, shown)))
        else:
            self.model = Tokenizer.from_file(vocabulary)
            self.model.encode_special_tokens = True
            names = self.model.get_vocab(with_added_tokens=False)
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in byte_characters().items()}
        self.raw = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.raw[i] = bytes(map(back.__getitem__, name))
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32 bytes."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token; the tokens of a split character all cover it."""
        ends = np.cumsum([len(self.raw[i]) for i in ids.tolist()], dtype=np.int64)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
        data = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1
        return char_of[starts], char_of[ends - 1] + 1


def _merges(ranks: dict[bytes, int], shown: dict[int, str]) -> list[tuple[str, str]]:
    """The merge that makes each token: the two parts left when lower ranks alone have merged its bytes."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append(tuple("".join(map(shown.__getitem__, p)) for p in parts))
    return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(vocabulary: str, pattern: str) -> Codec:
    key = (vocabulary, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary, pattern)
    return _codecs[key]


def _texts(column: pa.Array):
    for value in column:
        yield value.as_py() or ""


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``id, ids array<int>`` of every text, with ``starts, ends array<int>`` (characters) if asked for."""

    def run(batches):
        own = codec(vocabulary, pattern)
        for batch in batches:
            ids, starts, ends = [], [], []
            for text in _texts(batch.column(1)):
                x = np.frombuffer(own.encode(text), "<u4")
                ids.append(x.astype(np.int32))
                if offsets:
                    a, b = own.offsets(text, x)
                    starts.append(a.astype(np.int32))
                    ends.append(b.astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x in ([ids, starts, ends] if offsets else [ids]))], names=["id", "ids", "starts", "ends"][: 4 if offsets else 2])

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", starts array<int>, ends array<int>" if offsets else ""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>{more}")


def decode(coded: DataFrame, vocabulary: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, bytes, text`` of id lists; bytes that are no whole character become U+FFFD in text only."""

    def run(batches):
        own = codec(vocabulary, pattern)
        for batch in batches:
            raw = [own.decode(np.asarray(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], names=["id", "bytes", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, bytes binary, text string")


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per text: ``n_tokens``, SHA-256 of its ids and of the bytes decoded from them, and ``ids`` if asked for. Nothing is shuffled."""

    def run(batches):
        own = codec(vocabulary, pattern)
        for batch in in_slices(batches):
            n, a, b, kept = [], [], [], []
            for text in _texts(batch.column(1)):
                raw = own.encode(text)
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(own.decode(ids)).hexdigest())
                kept.append(ids.astype(np.int32) if with_ids else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
