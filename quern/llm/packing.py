"""Best-fit packing by minimum bin slack: token ids of whole documents in as few sequences as can be found.

``pieces`` encodes every text (units such as words are looked up in a bounded memo of
the worker, the others go through the tokenizers library) and cuts only
documents longer than a sequence. A packing depends on nothing but how many pieces
have each length, so ``plan`` works on that histogram, of at most ``capacity`` rows
however large the corpus is: the longest length left opens a sequence, a subset-sum
over bitsets finds the fullest combination of the other lengths that still fits, and
the combination is removed as often as the lengths allow, which is what a search for
each sequence by itself would do. A step leaves less than half of one length, so a
plan has at most about ``capacity * (2 + log2)`` steps and is broadcast whole.

``pack`` numbers the pieces of each length - by task, then within the task, so that no
window holds a length that a third of all documents have - and reads each piece's
sequence and offset from the plan.

Null and empty texts are the end token alone. Rows that repeat, also their id, are
packed each. Ties between combinations go to longer pieces. Only id and text are read.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, utf8

#: Bytes of text that are cut into words at once, and words that a worker remembers in each of two generations.
SLICE_BYTES, MEMO_WORDS = 4 << 20, 400_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: What a byte is: a byte of other characters than ASCII may be anything.
_OTHER, _BLANK, _LETTER, _DIGIT, _MARK = range(5)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[128:] = _OTHER
_KIND[_SPACE] = _BLANK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
#: Whether every match ends between bytes of these kinds.
_BORDER = np.array([[a != b and (_OTHER not in (a, b) or _BLANK in (a, b)) or a == _DIGIT for b in range(5)] for a in range(5)]).ravel()
#: The vocabulary is of lower case.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """One vocabulary in one Python process: units to ids.

    A unit is a text's stretch between two places where every match of the vocabulary's
    pattern ends: white space, a digit, or the border of ASCII punctuation and letters. So a
    text's ids are those of its units in a row.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        self.model.encode_special_tokens = True
        self.memo, self.older = {}, {}

    def _made(self, units: list[str]):
        """Each unit's ids as bytes. The library takes many units as words of one text, and names the word of each id."""
        for at in range(0, len(units), 5000):
            part = units[at : at + 5000]
            coded = self.model.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw = np.asarray(coded.ids, "<u4").tobytes()
            begin = 0
            for end in (4 * np.cumsum(np.bincount(np.asarray(coded.word_ids, np.int64), minlength=len(part)))).tolist():
                yield raw[begin:end]
                begin = end

    def ids(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units, as little-endian uint32. When the memo is full, it becomes the older generation; units in use come back from there."""
        out = list(map(self.memo.get, units))
        missing = [k for k, x in enumerate(out) if x is None]
        for k in missing:
            out[k] = self.older.get(units[k])
        new = [k for k in missing if out[k] is None]
        for k, x in zip(new, self._made([units[k] for k in new])):
            out[k] = x
        if missing:
            if len(self.memo) + len(missing) > MEMO_WORDS:
                self.memo, self.older = {}, self.memo
            self.memo.update((units[k], out[k]) for k in missing if len(units[k]) <= 64)
        return out


_words: dict[str, Words] = {}


def words_of(vocabulary: str) -> Words:
    if vocabulary not in _words:
        _words[vocabulary] = Words(vocabulary)
    return _words[vocabulary]


def by_bytes(batches, column: int, most: int = SLICE_BYTES):
    """The batches in parts of at most ``most`` bytes of text, of one row at least."""
    for batch in batches:
        _, off = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def _encoded(own: Words, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, each text's with the end token behind, and their n+1 offsets."""
    data, off = utf8(column)
    data = _LOWER[data]
    kind = _KIND[data]
    # the two bytes of a Latin letter with an accent
    pair = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    kind[:-1][pair] = kind[1:][pair] = _LETTER
    border = np.zeros(len(data) + 1, bool)
    border[1:-1] = _BORDER[kind[:-1] * 5 + kind[1:]]
    quote = np.flatnonzero(data[:-1] == 39) + 1
    border[quote[kind[quote] == _LETTER]] = False  # 's is one match
    border[off] = True
    edges = np.flatnonzero(border)
    begins, lengths = edges[:-1], np.diff(edges)
    real = kind[begins] != _BLANK
    begins, lengths = begins[real], lengths[real]
    held = data[kind != _BLANK]
    cuts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(cuts.tobytes()), pa.py_buffer(held.tobytes())).dictionary_encode()
    codes = words.indices.to_numpy()
    tables = own.ids(words.dictionary.to_pylist())
    size = np.fromiter(map(len, tables), np.int64, len(tables)) // 4
    flat = np.frombuffer(b"".join(tables), "<u4")
    n = size[codes]
    upto = np.concatenate(([0], np.cumsum(n)))
    own_ids = np.diff(upto[np.searchsorted(begins, off)])
    offsets = np.concatenate(([0], np.cumsum(own_ids + 1)))
    ids = np.full(int(offsets[-1]), end_id, "<u4")
    every = np.arange(int(upto[-1]))
    # one end token for each text before
    ids[every + np.repeat(np.arange(len(off) - 1), own_ids)] = flat[every + np.repeat((np.cumsum(size) - size)[codes] - upto[:-1], n)]
    return ids, offsets


def _parts(column: pa.Array) -> pa.Array:
    """The texts; a long one that fills its slice alone is cut behind white space."""
    if len(column) != 1 or len(data := utf8(column)[0]) <= SLICE_BYTES:
        return column
    cuts = [0]
    while len(data) - cuts[-1] > SLICE_BYTES:
        gaps = np.flatnonzero(_SPACE[data[cuts[-1] : cuts[-1] + SLICE_BYTES]])
        if not len(gaps):  # one word, longer than a slice
            gaps = np.flatnonzero(_SPACE[data[cuts[-1] :]])[:1]
        if not len(gaps):
            break
        cuts.append(cuts[-1] + int(gaps[-1]) + 1)
    ends = np.array([*cuts, len(data)], np.int64)
    return pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, nth``: the nth piece of its length in its task; ``part`` is the task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own, part, seen = words_of(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in by_bytes(batches, 1):
            ids, off = _encoded(own, _parts(batch.column(1)), end_id)
            if len(off) - 1 > batch.num_rows:  # one text in several parts
                ids = np.append(np.delete(ids, off[1:] - 1), np.array([end_id], "<u4"))
                off = np.array([0, len(ids)])
            number = -(-np.diff(off) // capacity)
            row = np.repeat(np.arange(batch.num_rows), number)
            piece = _within(number)
            start = piece * capacity
            length = np.minimum(np.diff(off)[row] - start, capacity)
            at = off[row] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            ranks = np.empty(len(length), np.int64)
            counts = np.bincount(length, minlength=capacity + 1)
            ranks[order] = _within(counts)
            nth = seen[length] + ranks
            seen += counts
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


@dataclass(frozen=True)
class Step:
    """``times`` sequences that each hold ``uses[length]`` pieces of a length."""

    times: int
    uses: dict[int, int]


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``; longer pieces first.

    Bit s of ``reach`` tells whether the lengths so far make s. A length's pieces enter
    in powers of two, and the sums before each are kept to walk back.
    """
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        left, power = min(counts[n], room // n), 1
        while left:
            take = min(power, left)
            trail.append((n, take, reach))
            reach |= (reach << n * take) & mask
            left, power = left - take, power * 2
        if reach >> room:
            break
    total, uses = reach.bit_length() - 1, {}
    for n, take, before in reversed(trail):
        if not before >> total & 1:
            uses[n] = uses.get(n, 0) + take
            total -= n * take
    return uses


def plan(histogram: dict[int, int], capacity: int) -> list[Step]:
    """Steps that use up the histogram ``length: pieces``."""
    counts, steps = {n: k for n, k in histogram.items() if k}, []
    lengths = sorted(counts, reverse=True)
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        uses = fullest(counts, lengths if counts[seed] else lengths[1:], capacity - seed)
        counts[seed] += 1
        uses[seed] = uses.get(seed, 0) + 1
        times = min(counts[n] // k for n, k in uses.items())
        steps.append(Step(times, uses))
        for n, k in uses.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
                lengths.remove(n)
    return steps


def _intervals(steps: list[Step]) -> dict[int, np.ndarray]:
    """By length, rows ``first rank, first sequence, pieces in a sequence, offset``: where the plan puts the length's pieces."""
    rows, used, sequence = {}, {}, 0
    for step in steps:
        at = 0
        for n in sorted(step.uses, reverse=True):
            k = step.uses[n]
            rows.setdefault(n, []).append((used.get(n, 0), sequence, k, at))
            used[n] = used.get(n, 0) + step.times * k
            at += n * k
        sequence += step.times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of the written table ``cut`` that ``pieces`` made."""
    spark = cut.sparkSession
    sizes = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # a row a length, at most capacity of them
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = spark.sparkContext.broadcast(_intervals(plan(histogram, capacity)))
    # a row a task for each length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = cut.join(sizes.select("length", "part", before.alias("before")), ["length", "part"])
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    kind = cut.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                table = placed.value[int(n)]
                first, seq, each, at = table[np.searchsorted(table[:, 0], rank[own], "right") - 1].T
                sequence[own] = seq + (rank[own] - first) // each
                offset[own] = at + (rank[own] - first) % each * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit(docs: DataFrame, scratch: Scratch, vocabulary: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces of all documents with their place. The pieces, a few numbers each, are written once: numbers of a task must not change."""
    return pack(scratch.save(pieces(docs, vocabulary, end_id, capacity, id_col, text_col)), capacity)
