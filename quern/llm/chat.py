"""Chat formatting: roles recovered from transcripts by a hidden Markov model.

A transcript is a sequence of lines. The hidden state of a line is its role and
whether it begins a turn; the observed symbol is made of its speaker marker (``User:``,
``A:`` ...), its length, its closing mark and whether it is the transcript's first.
``train`` counts transitions and emissions over a bounded sample of labelled lines;
``parse`` finds the best path by Viterbi. ``turns`` writes the canonical form: a turn
opens with ``<|role|>``, closes with ``<|end|>``, and its marker is cut; ``<|`` in a
text becomes ``<\\|``, so a text cannot forge a role.

A transcript of any length is done in chunks of ``chunk`` lines: each chunk's best
scores from every state to every state are one small matrix (with the first state of
each best path), the matrices are combined along the transcript, and then each chunk is
decoded between its known ends. No task holds a whole transcript; what is combined is
one small matrix per chunk. Chunks are dealt into bins, and all chunks of a bin are
decoded at once, step by step.

Null or empty lines are lines without a marker. Lines with the same place are ordered
by their text. A null transcript id is a transcript of its own. Without training data
all counts are the prior's. Ties go to the state listed first. Only the transcript's
id, place and line are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

ROLES = ("system", "user", "assistant")
#: State 2r begins a turn of role r, 2r+1 goes on with it.
STATES = 2 * len(ROLES)
# Speaker markers.
MARKERS = {"system": ("system", "instructions"), "user": ("user", "human", "q", "question", "customer"), "assistant": ("assistant", "ai", "bot", "a", "answer", "agent")}
MARKER = rf"(?i)^\s*(?:#+\s*|\*\*|\[|<\|?)?({'|'.join(sorted((w for ws in MARKERS.values() for w in ws), key=len, reverse=True))})(?:\*\*)?\s*(?::|\]:?|\|?>)(?:\*\*)?\s*"
SYMBOLS = 4 * 5 * 3 * 2
END = "<|end|>"


@dataclass(frozen=True)
class Model:
    """Log-probabilities; the state after the last is the one before the first line."""

    step: np.ndarray
    emit: np.ndarray

    def at(self, state: int) -> np.ndarray:
        return np.where(np.arange(len(self.step)) == state, 0.0, -np.inf)


def bare(line: Column) -> Column:
    """The line without its marker."""
    return F.regexp_replace(F.coalesce(line, F.lit("")), MARKER, "")


def symbol(line: Column, first: Column) -> Column:
    """The observed symbol of a line, a number below SYMBOLS."""
    word = F.lower(F.regexp_extract(F.coalesce(line, F.lit("")), MARKER, 1))
    kind = F.when(word == "", 0)
    for k, role in enumerate(ROLES):
        kind = kind.when(word.isin(*MARKERS[role]), k + 1)
    text = F.regexp_replace(bare(line), r"(?U)^\s+|\s+$", "")
    n = F.length(text)
    size = F.when(n < 1, 0).when(n < 80, 1).when(n < 250, 2).when(n < 800, 3).otherwise(4)
    close = F.when(text.endswith("?"), 1).when(text.endswith(".") | text.endswith("!"), 2).otherwise(0)
    return (((F.coalesce(kind, F.lit(0)) * 5 + size) * 3 + close) * 2 + first.cast("int")).cast("int")


def train(lines: DataFrame, max_transcripts: int = 2_000, prior: float = 0.1) -> Model:
    """From ``conv, pos, line, state`` of at most about ``max_transcripts`` transcripts (hash of conv)."""
    n = lines.select("conv").distinct().count()
    drawn = lines.filter(F.pmod(F.xxhash64(F.lit("chat"), "conv"), F.lit(1_000_000)) < 1_000_000 * min(1.0, max_transcripts / max(n, 1)))
    state, block = F.col("state").cast("int"), F.floor(F.col("pos") / 4096)
    # a block's first line follows the last one of the block before; a window over a whole transcript might be most of the rows
    ends = drawn.groupBy(F.col("conv").alias("_conv"), (block + 1).alias("_block")).agg(F.max(F.struct("pos", "line", state.alias("state")))["state"].alias("end"))
    order = Window.partitionBy("conv", block).orderBy("pos", "line")
    lagged = drawn.select("conv", block.alias("block"), symbol(F.col("line"), F.col("pos") == 0).alias("symbol"), state.alias("state"), F.lag(state).over(order).alias("before"))
    joined = lagged.join(ends, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    seen = joined.select("symbol", "state", F.coalesce("before", "end").alias("last"))
    # at most SYMBOLS x STATES x (STATES + 1) rows
    counted = seen.groupBy("symbol", "state", "last").count().collect()
    first, step, emit = np.full(STATES, prior), np.full((STATES, STATES), prior), np.full((STATES, SYMBOLS), prior)
    for symbol_, state, last, many in counted:
        emit[state, symbol_] += many
        if last is None:
            first[state] += many
        else:
            step[last, state] += many
    # a turn goes on in its own role only
    for r in range(len(ROLES)):
        for s in range(STATES):
            if s // 2 != r:
                step[s, 2 * r + 1] = 1e-12
        first[2 * r + 1] = 1e-12
    steps, emits = np.full((STATES + 1, STATES + 1), -np.inf), np.full((STATES + 1, SYMBOLS), -np.inf)
    steps[:STATES, :STATES], steps[STATES, :STATES] = np.log(step / step.sum(1, keepdims=True)), np.log(first / first.sum())
    emits[:STATES] = np.log(emit / emit.sum(1, keepdims=True))
    return Model(steps, emits)


def transfer(symbols: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """From each state before the chunk to each state at its end: the best score, and the path's first state."""
    best = np.where(np.eye(len(model.step), dtype=bool), 0.0, -np.inf)
    first = None
    for s in symbols:
        ways = best[:, :, None] + model.step[None]
        by = ways.argmax(1)
        best = np.take_along_axis(ways, by[:, None, :], 1)[:, 0] + model.emit[:, s][None]
        first = np.broadcast_to(np.arange(len(model.step)), best.shape) if first is None else np.take_along_axis(first, by, 1)
    return best, first


def viterbi(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, before: np.ndarray, last: np.ndarray, model: Model) -> np.ndarray:
    """The best states of many chunks at once: chunk k is ``symbols[begin[k] : begin[k] + size[k]]``; ends of -1 are open."""
    order = np.argsort(-size, kind="stable")
    begin, sizes, last = begin[order], size[order], last[order]
    score = np.stack([model.at(len(model.step) - 1 if b < 0 else b) for b in before[order]]) if len(order) else np.zeros((0, len(model.step)))
    back = np.zeros((len(symbols), len(model.step)), np.int8)
    # longest chunks first: those that still have a line at step t are the first ones
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes.max(initial=0)))]
    for t, n in enumerate(active):
        at = begin[:n] + t
        ways = score[:n, :, None] + model.step[None]
        back[at] = ways.argmax(1)
        score[:n] = ways.max(1) + model.emit[:, symbols[at]].T
    state = np.where(last >= 0, last, score.argmax(1))
    path = np.zeros(len(symbols), np.int64)
    for t in range(len(active) - 1, -1, -1):
        at = begin[: active[t]] + t
        path[at] = state[: active[t]]
        state[: active[t]] = back[at, path[at]]
    return path


def _chunks(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The lines in order, and where their chunks begin and how long they are."""
    table = table.sort_by([("key", "ascending"), ("chunk", "ascending"), ("pos", "ascending"), ("line", "ascending")])
    key, chunk = table["key"].combine_chunks().dictionary_encode().indices.to_numpy(), table["chunk"].to_numpy()
    begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])))) if len(key) else np.zeros(0, np.int64)
    return table, begin, np.diff(np.concatenate((begin, [len(key)])))


def _decoded(spark: SparkSession, lines: DataFrame, model: Model, chunk: int, bin_lines: int, write, schema: str) -> DataFrame:
    """``write(table, begin, size, path, after)`` of every bin's chunks; after is the state of the line behind a chunk, -1 without."""
    held = spark.sparkContext.broadcast(model)
    bins = max(1, lines.count() // bin_lines)
    key = F.coalesce(F.col("conv").cast("string"), F.lit("\x00null"))
    rows = lines.select("conv", key.alias("key"), F.col("pos").cast("long").alias("pos"), F.coalesce("line", F.lit("")).alias("line"), F.floor(F.col("pos") / chunk).cast("long").alias("chunk"))
    marked = rows.withColumn("symbol", symbol(F.col("line"), F.col("pos") == 0)).withColumn("bin", F.pmod(F.xxhash64("key", "chunk"), F.lit(bins)))

    def matrices(table: pa.Table) -> pa.Table:
        table, begin, size = _chunks(table)
        symbols = table["symbol"].to_numpy()
        both = [transfer(symbols[b : b + n], held.value) for b, n in zip(begin, size)]
        flat = lambda k, kind: pa.array([x[k].ravel().tolist() for x in both], pa.list_(kind))
        return pa.table([table["key"].take(begin), table["chunk"].take(begin), flat(0, pa.float64()), flat(1, pa.int32())], names=["key", "chunk", "best", "first"])

    # only transcripts of several chunks need them
    long = marked.filter(F.col("chunk") > 0).select("key").distinct()
    found = marked.join(long, "key", "left_semi").select("bin", "key", "chunk", "pos", "line", "symbol").groupBy("bin").applyInArrow(matrices, "key string, chunk long, best array<double>, first array<int>")

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        m = held.value
        steps, firsts = ([np.array(x).reshape(m.step.shape) for x in table[c].to_pylist()] for c in ("best", "first"))
        scores, score = [], m.at(STATES)
        for best in steps:
            scores.append(score)
            score = (score[:, None] + best).max(0)
            score = score - score.max()
        state, last = int(score.argmax()), []
        for score, best in zip(reversed(scores), reversed(steps)):
            last.append(state)
            state = int((score + best[:, state]).argmax())
        last = last[::-1]
        before = [STATES, *last[:-1]]
        after = [int(f[b, e]) for f, b, e in zip(firsts[1:], before[1:], last[1:])] + [-1]
        return pa.table([table["key"], table["chunk"], *(pa.array(x, pa.int32()) for x in (before, last, after))], names=["key", "chunk", "before", "last", "after"])

    known = found.groupBy("key").applyInArrow(ends, "key string, chunk long, before int, last int, after int")
    joined = marked.join(known, ["key", "chunk"], "left").select("bin", "conv", "key", "chunk", "pos", "line", "symbol", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("before", "last", "after")])

    def decode(table: pa.Table) -> pa.Table:
        table, begin, size = _chunks(table)
        before, last, after = (table[c].to_numpy()[begin] for c in ("before", "last", "after"))
        path = viterbi(table["symbol"].to_numpy(), begin, size, before, last, held.value)
        return write(table, begin, size, path, after)

    return joined.groupBy("bin").applyInArrow(decode, schema)


def parse(spark: SparkSession, lines: DataFrame, model: Model, chunk: int = 512, bin_lines: int = 20_000) -> DataFrame:
    """``conv, pos, line, role, begins`` for every line of ``lines (conv, pos, line)``; pos counts a transcript's lines from 0."""

    def write(table, begin, size, path, after):
        return pa.table([table["conv"], table["pos"], table["line"], pa.array([ROLES[s // 2] for s in path], pa.string()), pa.array(path % 2 == 0, pa.bool_())], names=["conv", "pos", "line", "role", "begins"])

    return _decoded(spark, lines, model, chunk, bin_lines, write, f"conv {lines.schema['conv'].dataType.simpleString()}, pos long, line string, role string, begins boolean")


def turns(spark: SparkSession, lines: DataFrame, model: Model, chunk: int = 512, bin_lines: int = 20_000) -> DataFrame:
    """``conv, pos, lines, role, opens, closes, rendered``: the turns of every transcript in canonical form.

    pos is the place of a turn's first line. A turn that reaches into another chunk goes
    on there in a row of its own, without opening, so no row has more than ``chunk``
    lines; in the order of pos, rows joined by newlines are the whole transcript.
    """
    raw = _decoded(spark, lines, model, chunk, bin_lines, _runs, f"conv {lines.schema['conv'].dataType.simpleString()}, pos long, lines int, role string, opens boolean, closes boolean, texts array<string>")
    safe = F.transform("texts", lambda x, i: F.regexp_replace(F.when((i == 0) & F.col("opens"), bare(x)).otherwise(x), r"<(\\*)\|", r"<$1\\|"))
    whole = F.concat(F.when(F.col("opens"), F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))).otherwise(""), F.array_join(safe, "\n"), F.when(F.col("closes"), F.lit(f"\n{END}")).otherwise(""))
    return raw.select("conv", "pos", "lines", "role", "opens", "closes", whole.alias("rendered"))


def _runs(table: pa.Table, begin: np.ndarray, size: np.ndarray, path: np.ndarray, after: np.ndarray) -> pa.Table:
    """The lines of a bin's chunks by turns."""
    opens = path % 2 == 0
    opens_or_chunk = opens.copy()
    opens_or_chunk[begin] = True
    start = np.flatnonzero(opens_or_chunk)
    stop = np.concatenate((start[1:], [len(path)])).astype(np.int64)
    # a run is closed by the next line of its chunk, or by what stands behind the chunk
    closes = np.ones(len(start), bool)
    ends = np.searchsorted(stop, begin + size)
    closes[ends] = (after < 0) | (after % 2 == 0)
    text = pa.ListArray.from_arrays(pa.array(np.concatenate((start, [len(path)])), pa.int32()), table["line"].combine_chunks())
    return pa.table([table["conv"].take(start), table["pos"].take(start), pa.array(stop - start, pa.int32()), pa.array([ROLES[s // 2] for s in path[start]], pa.string()), pa.array(opens[start], pa.bool_()), pa.array(closes, pa.bool_()), text], names=["conv", "pos", "lines", "role", "opens", "closes", "texts"])
