"""Conversation structure repair: error-correcting Earley parsing of the speakers' roles.

The grammar of whole conversations is weighted: besides keeping a row, its productions
delete one, give it the role that fits, or insert an empty turn. It is left-linear, so that every
item of the chart begins at the first row and a position holds a fixed number of items; an item
keeps the least (cost, audit) of its derivations, the audit being the initials of the
edits. Two derivations of an item with equal cost consume the same rows, so neither
audit begins with the other, and comparing them early is comparing them late. The completed
chart's audit is the repair.

``repair`` sorts all rows by conversation, turn, role, the first characters of the text and a hash of it,
dealt out by ranges, so that a conversation of any length lies in consecutive
partitions. A conversation that lies within one partition is repaired where it is. The
others are written in pieces of at most PIECE_ROWS rows: rows that a piece before has already
are found by a digest, each piece is parsed from every nonterminal that may be complete where it begins (a
matrix of costs, and ranks of audits), matrices are joined in a tree, and the way back
down tells each piece where its repair begins and ends. Only the digest of a whole
conversation's repaired text is sequential by its nature: its pieces stream through one
task in order, with the state of the hash and the counts, never as a whole.

Null roles and texts are one space. Rows of a null turn come first; rows that share
a turn are ordered as above, and rows that repeat all of it are duplicates of the first.
A conversation without rows has zeros, an empty audit and the digest of nothing. Only
conversation, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch

#: Costs of the edits, and of leaving a truncated row in place.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Most rows and characters of a piece, and children of a node in the tree of pieces (2 to this power).
PIECE_ROWS, PIECE_CHARS, FAN_BITS = 1024, 1 << 21, 8

#: Nonterminals that end where a row ends: nothing said yet, a system turn, an open question, an answered one.
STATES = ("Begin", "Head", "Asked", "Told")
#: The grammar: what is said is a preterminal, in lower case, whose ways are in ``_ways``.
GRAMMAR = (
    ("Repair", ("Begin",)), ("Repair", ("Told",)),
    ("Head", ("Begin", "system")),
    ("Asked", ("Begin", "user")), ("Asked", ("Head", "user")), ("Asked", ("Told", "user")),
    ("Told", ("Asked", "assistant")),
    *((state, (state, "junk")) for state in STATES),
)
_RULES = {head: [k for k, (h, _) in enumerate(GRAMMAR) if h == head] for head in ("Repair", *STATES)}
_WHITE = " \t\n\x0b\x0c\r"


def symbol(role: str, fault: str) -> str:
    """A row as the parser sees it: the role's initial, in upper case if the row is truncated; ``-`` if it has to go."""
    if fault in ("blank", "duplicate"):
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault == "truncated" else initial


def _ways(word: str, row: str | None):
    """``consumes, cost, audit`` of the ways to read a preterminal at a row (None: behind the last)."""
    if word in ("user", "assistant"):
        yield False, INSERT, "I"
    if row is None:
        return
    if word == "junk":
        yield True, DELETE, "D"
    elif row != "-":
        more = TRUNCATED if row.isupper() else 0
        if row.lower() == word[0]:
            yield True, more, "K"
        elif word != "system":
            yield True, REROLE + more, "R"


def chart(rows: str, entry: str = "Begin") -> list[tuple[dict, dict]]:
    """For each position the items that a row led to, and all items: ``(rule, dot, origin) -> (cost, audit)``.

    ``entry`` is complete, and costs nothing, before the first row. Items go back on the agenda
    when they get better.
    """
    sets = [{} for _ in range(len(rows) + 1)]
    out = []
    entered = (("entry", entry), 1, 0)  # an item without a rule of its own
    for at, own in enumerate(sets):
        arrived, agenda = dict(own), list(own)
        row = rows[at] if at < len(rows) else None

        def add(item, value, to=own, agenda=agenda):
            if item not in to or value < to[item]:
                to[item] = value
                if agenda is not None:
                    agenda.append(item)

        if at == 0:
            for k in _RULES["Repair"]:
                add((k, 0, 0), (0, ""))
            add(entered, (0, ""))
        while agenda:
            item = agenda.pop()
            rule, dot, origin = item
            value = own[item]
            head, body = (rule[1], (None,)) if rule.__class__ is tuple else GRAMMAR[rule]
            if dot == len(body):  # complete
                for (k, d, o), before in list(sets[origin].items()):
                    if k.__class__ is int and d < len(GRAMMAR[k][1]) and GRAMMAR[k][1][d] == head:
                        add((k, d + 1, o), (before[0] + value[0], before[1] + value[1]))
            elif body[dot] in _RULES:  # predict
                for k in _RULES[body[dot]]:
                    add((k, 0, at), (0, ""))
                for (k, d, o), done in list(own.items()):  # what is complete here without a row
                    name, length = (k[1], 1) if k.__class__ is tuple else (GRAMMAR[k][0], len(GRAMMAR[k][1]))
                    if o == at and d == length and name == body[dot]:
                        add((rule, dot + 1, origin), (value[0] + done[0], value[1] + done[1]))
            else:  # scan, or insert
                for consumes, cost, audit in _ways(body[dot], row):
                    made = (value[0] + cost, value[1] + audit)
                    if consumes:
                        add((rule, dot + 1, origin), made, sets[at + 1], None)
                    else:
                        add((rule, dot + 1, origin), made)
        out.append((arrived, own))
    return out


def _complete(items: dict, head: str):
    return min((v for (k, d, o), v in items.items() if k.__class__ is int and o == 0 and d == len(GRAMMAR[k][1]) and GRAMMAR[k][0] == head), default=None)


@lru_cache(100_000)
def repaired(rows: str, entry: str = "Begin") -> tuple[int, str]:
    """Cost and audit of the cheapest repair of whole rows."""
    return _complete(chart(rows, entry)[-1][1], "Repair")


@lru_cache(2_000)
def passages(rows: str, entry: str) -> tuple[tuple[int, str] | None, ...]:
    """For each of STATES, cost and audit of the cheapest way to it whose last edit is of the last row."""
    arrived = chart(rows, entry)[-1][0]
    return tuple(_complete(arrived, state) for state in STATES)


def lines(rows, audit: str, state: str):
    """The repaired ``role:text`` of ``rows (role, text)`` that the audit leaves, and the state behind them."""
    at, out = 0, []
    for edit in audit:
        wanted = "assistant" if state == "Asked" else "user"
        if edit == "I":
            out.append(f"{wanted}:")
        else:
            role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            if edit == "K" and state == "Begin" and role[:1] == "s":
                out.append(f"{role}:{text}")
                state = "Head"
                continue
            out.append(f"{role if edit == 'K' else wanted}:{text}")
        state = "Told" if wanted == "assistant" else "Asked"
    return out, state


class _Tally:
    """Counts, audit and digest of one conversation whose rows come in order."""

    def __init__(self):
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.rows = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit, self.sha, self.first = [], hashlib.sha256(), True

    def see(self, turn, role: str, fault: str) -> None:
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.turn
            self.turn = turn
        if self.rows and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial, self.rows = role[:1], self.rows + 1
        if fault:
            self.faults[fault] += 1

    def say(self, cost: int, audit: str, said: list[str]) -> None:
        self.cost += cost
        self.audit.append(audit)
        for line in said:
            self.sha.update((line if self.first else "\n" + line).encode())
            self.first = False

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


#: What the contract returns for a conversation, after its id.
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_ROWS = "array<struct<turn:long,role:string,text:string,fault:string,seen:binary>>"
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("seen", pa.binary())])


def _fault(text: str, again: bool) -> str:
    visible = text.rstrip(_WHITE)
    return "blank" if not visible else "duplicate" if again else "" if visible[-1] in ".!?" else "truncated"


def _seen(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _whole(rows) -> tuple:
    """The result of a conversation that is all here: rows ``(turn, role, text, fault, digest)``."""
    tally = _Tally()
    for turn, role, _, fault, _ in rows:
        tally.see(turn, role, fault)
    cost, audit = repaired("".join(symbol(r[1], r[3]) for r in rows))
    tally.say(cost, audit, lines([r[1:3] for r in rows], audit, "Begin")[0])
    return tally.result()


def _scanned(batches, most: int = PIECE_ROWS):
    """Sorted rows ``key, turn, role, text`` to results of conversations that begin and end here, and pieces of at most ``most`` rows of the others."""
    part, held, seen, chars, key, number, alone = TaskContext.get().partitionId(), [], set(), 0, None, 0, False
    done, cut = [], []

    def piece():
        cut.append((key, part, number, [dict(zip(("turn", "role", "text", "fault", "seen"), r)) for r in held]))

    def out():
        rows = [(k, None, None, None, *r) for k, r in done] + [(*p, *[None] * len(_NAMES)) for p in cut]
        columns = list(zip(*rows)) if rows else [()] * (4 + len(_NAMES))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(_ROW), *[pa.int64()] * 6, pa.string(), pa.string()]
        done.clear()
        cut.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "part", "number", "rows", *_NAMES])

    first = True
    for batch in batches:
        for own, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if first or own != key:
                if not first:
                    if alone:
                        done.append((key, _whole(held)))
                    else:
                        piece()
                held, seen, chars, key, number, alone, first = [], set(), 0, own, 0, not first, False
            elif len(held) >= most or chars >= PIECE_CHARS:
                piece()
                held, seen, chars, number, alone = [], set(), 0, number + 1, False
                if len(cut) >= 4:
                    yield out()
            digest = _seen(role, text)
            held.append((turn, role, text, _fault(text, digest in seen), digest))
            seen.add(digest)
            chars += len(text)
        if done or cut:
            yield out()
    if not first:
        piece()
        yield out()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as a broken export would have them: by a checksum of id and turn a row of twenty is lost, emptied, left without ends of sentences, repeated or given to the user."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    rows = conversations.filter(case != 0).select("conv_id", "turn", F.when(case == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def repair(rows: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``key`` (``=`` and the conversation's id, or ``null``) with the RESULT of each conversation that has rows."""
    own = lambda c: F.coalesce(F.col(c), F.lit(" "))
    # rows that repeat everything are told apart by their place in the input, so that ranges may part them
    named = rows.select(_key(conv_col).alias("key"), F.col(turn_col).cast("long").alias("turn"), own(role_col).alias("role"), own(text_col).alias("text"), F.monotonically_increasing_id().alias("_at"))
    order = ["key", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), "_at"]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order).drop("_at")
    scanned = scratch.save(dealt.mapInArrow(partial(_scanned, most=piece_rows), f"key string, part int, number long, rows {_ROWS}, {RESULT}"))
    done = scanned.filter("rows is null").select("key", *_NAMES)
    return done.unionByName(_across(scanned.filter("rows is not null").select("key", "part", "number", "rows"), scratch))


def _across(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """Results of conversations in ``pieces (key, part, number, rows)``, in whatever partitions those are."""
    pieces = scratch.save(_without_repeats(pieces))

    def parsed(batches):
        for batch in batches:
            costs, ranks = [], []
            for word in batch.column(3).to_pylist():
                found = [passages(word, entry) for entry in STATES]
                audits = sorted({x[1] for ways in found for x in ways if x})
                costs.append([x[0] if x else None for ways in found for x in ways])
                ranks.append([audits.index(x[1]) if x else None for ways in found for x in ways])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))], names=["key", "part", "number", "cost", "rank"])

    schema = "key string, {} cost array<long>, rank array<int>"
    word = F.array_join(F.transform("rows", _symbol), "")
    leaves = scratch.save(pieces.select("key", "part", "number", word.alias("word")).mapInArrow(parsed, schema.format("part int, number long,")))
    # up: the pieces of a partition, then partitions by FAN_BITS bits of their number
    levels = [leaves.select("key", F.col("part").cast("long").alias("up"), F.col("number").alias("nth"), "cost", "rank")]
    most, shift = leaves.agg(F.max("part")).first()[0] or 0, 0
    while True:
        joined = levels[-1].groupBy("key", "up").applyInPandas(_joined, schema.format("up long,"))
        done = not most >> shift
        shift += FAN_BITS
        # a node's number within its parent is its own number: only its order counts
        joined = scratch.save(joined.select("key", F.shiftright("up", FAN_BITS).alias("up"), F.col("up").alias("nth"), "cost", "rank"))
        if done:
            break
        levels.append(joined)
    # down: each conversation is one node by now
    ends = joined.groupBy("key").applyInPandas(_root, "key string, up long, entry int, leave int")
    for level in reversed(levels):
        ends = scratch.save(level.join(ends, ["key", "up"]).groupBy("key", "up").applyInPandas(_ends, "key string, up long, nth long, entry int, leave int"))
        if level is not levels[0]:
            ends = ends.select("key", F.col("nth").alias("up"), "entry", "leave")
    ends = ends.select("key", F.col("up").cast("int").alias("part"), F.col("nth").alias("number"), "entry", "leave")
    whole = pieces.join(ends, ["key", "part", "number"]).select("key", "part", "number", "rows", "entry", "leave")
    return whole.repartition("key").sortWithinPartitions("key", "part", "number").mapInArrow(_streamed, f"key string, {RESULT}")


def _without_repeats(pieces: DataFrame) -> DataFrame:
    """Marks rows whose role and text an earlier piece of the conversation has. A piece brings each of its texts once, as a digest."""
    each = pieces.select("key", "part", "number", F.posexplode("rows").alias("at", "row")).filter("row.fault in ('', 'truncated')")
    each = each.select("key", F.col("row.seen").alias("seen"), F.struct("part", "number").alias("piece"), "at")
    first = each.groupBy("key", "seen").agg(F.min("piece").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = each.join(first, ["key", "seen"]).filter("piece > first").groupBy("key", "piece").agg(F.collect_set("at").alias("again"))
    marked = pieces.join(again.select("key", "piece.part", "piece.number", "again"), ["key", "part", "number"], "left")
    fault = lambda r, i: F.when(F.array_contains("again", i), "duplicate").otherwise(r["fault"])
    return marked.select("key", "part", "number", F.transform("rows", lambda r, i: F.struct(r["turn"].alias("turn"), r["role"].alias("role"), r["text"].alias("text"), fault(r, i).alias("fault"))).alias("rows"))


def _symbol(row: Column) -> Column:
    initial = F.substring(row["role"], 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(row["fault"].isin("blank", "duplicate"), "-").when(row["fault"] == "truncated", F.upper(initial)).otherwise(initial)


_N = len(STATES)


def _matrix(cost, rank) -> list[list[tuple[int, int] | None]]:
    return [[None if cost[a * _N + b] is None or np.isnan(cost[a * _N + b]) else (int(cost[a * _N + b]), int(rank[a * _N + b])) for b in range(_N)] for a in range(_N)]


def _step(held, matrix):
    """One more piece behind ``held[state] = (cost, rank of the audit)``: the same behind it, and the state each came through."""
    made = []
    for b in range(_N):
        made.append(min(((held[a][0] + matrix[a][b][0], (held[a][1], matrix[a][b][1]), a) for a in range(_N) if held[a] and matrix[a][b]), default=None))
    order = sorted({x[1] for x in made if x})
    return [x and (x[0], order.index(x[1])) for x in made], [x and x[2] for x in made]


def _joined(table: pd.DataFrame) -> pd.DataFrame:
    """The matrix of consecutive pieces from their own. Ranks are of all sixteen audits together."""
    table = table.sort_values("nth")
    whole = None
    for cost, rank in zip(table["cost"], table["rank"]):
        matrix = _matrix(cost, rank)
        if whole is None:
            whole = matrix
            continue
        made = [[min(((row[a][0] + matrix[a][b][0], (row[a][1], matrix[a][b][1])) for a in range(_N) if row[a] and matrix[a][b]), default=None) for b in range(_N)] for row in whole]
        order = {r: k for k, r in enumerate(sorted({x[1] for row in made for x in row if x}))}
        whole = [[x and (x[0], order[x[1]]) for x in row] for row in made]
    flat = [x for row in whole for x in row]
    return pd.DataFrame({"key": [table["key"].iloc[0]], "up": [table["up"].iloc[0]], "cost": [[x and x[0] for x in flat]], "rank": [[x and x[1] for x in flat]]})


def _root(table: pd.DataFrame) -> pd.DataFrame:
    """The state in which the cheapest repair of the whole leaves the last row."""
    row = _matrix(table["cost"].iloc[0], table["rank"].iloc[0])[0]
    ends = [repaired("", state) for state in STATES]
    leave = min((row[b][0] + ends[b][0], row[b][1], ends[b][1], b) for b in range(_N) if row[b])[-1]
    return pd.DataFrame({"key": [table["key"].iloc[0]], "up": [table["nth"].iloc[0]], "entry": [0], "leave": [leave]})


def _ends(table: pd.DataFrame) -> pd.DataFrame:
    """For the pieces of a node whose first and last state are known, those of each piece."""
    table = table.sort_values("nth")
    held = [None] * _N
    held[int(table["entry"].iloc[0])] = (0, 0)
    ways = []
    for cost, rank in zip(table["cost"], table["rank"]):
        held, way = _step(held, _matrix(cost, rank))
        ways.append(way)
    states = [int(table["leave"].iloc[0])]
    for way in reversed(ways):
        states.append(way[states[-1]])
    states.reverse()
    return pd.DataFrame({"key": table["key"], "up": table["up"], "nth": table["nth"], "entry": states[:-1], "leave": states[1:]})


def _streamed(batches):
    """Pieces in order to results."""
    key, tally, state = None, None, None

    def result():
        cost, audit = repaired("", state)
        tally.say(cost, audit, lines([], audit, state)[0])
        values = tally.result()
        kinds = [*[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), *(pa.array([v], k) for v, k in zip(values, kinds))], names=["key", *_NAMES])

    for batch in batches:
        for at in range(batch.num_rows):
            own, rows, entry, leave = (batch.column(c)[at].as_py() for c in (0, 3, 4, 5))
            if own != key:
                if tally:
                    yield result()
                key, tally = own, _Tally()
            word = "".join(symbol(r["role"], r["fault"]) for r in rows)
            for r in rows:
                tally.see(r["turn"], r["role"], r["fault"])
            cost, audit = passages(word, STATES[entry])[leave]
            said, state = lines([(r["role"], r["text"]) for r in rows], audit, STATES[entry])
            tally.say(cost, audit, said)
    if tally:
        yield result()


def repair_all(rows: DataFrame, conversations: DataFrame, scratch: Scratch, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``conv_id`` of every conversation, with the RESULT of those ``rows`` of it that are there; the run's other tables are deleted."""
    every = conversations.select("conv_id").distinct().withColumn("key", _key("conv_id"))
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    none = [F.coalesce(n, empty.get(n, F.lit(0).cast("long"))).alias(n) for n in _NAMES]
    return scratch.only(every.join(repair(rows, scratch, piece_rows=piece_rows), "key", "left").select("conv_id", *none))
