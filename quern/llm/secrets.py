"""Secret scans with a trigram inverted index; DataFrame functions only.

``alternatives`` derives from a rule's regular expression the sets of trigrams of
which every match must contain one whole set. ``index`` writes the postings of all
trigrams that any rule asks for (trigram, document). ``candidates`` intersects them:
a document is a candidate of a rule if it has all trigrams of one of its sets. Only
candidates are searched with the expression; a rule without mandatory trigrams is
searched for in every text.

Texts are compared in lower case for the index, so it never misses. Candidates are
joined back to their texts through a broadcast bitmap of fixed size (``common.apart``):
only texts that hold a candidate's trigrams are shuffled. Spans are code points, end
exclusive. Null texts count as empty and have no spans. Rows that repeat an id may be
searched in vain, which changes nothing; rows without an id are searched for every
rule. Only id and text are read.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, apart


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts (0: the match), and the least length; shorter matches are dropped.
    group: int = 0
    least: int = 0


# The rules, in the order of their kinds.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # begins where no token does already, and gives nothing back: a long run is read once
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

def alternatives(pattern: str, most: int = 64) -> list[frozenset[str]]:
    """Sets of lower-case trigrams; a match contains all of at least one set. Empty list: no such sets."""
    # a state: trigrams so far, and the literal text that the next characters continue
    states = _walk(parser.parse(pattern), {(frozenset(), "")}, most)
    found = [grams for grams, _ in states] if states else []
    least = [g for g in set(found) if not any(h < g for h in found)]  # a larger set adds nothing
    return [] if not found or any(not g for g in found) else sorted(least, key=sorted)


def _add(states, chars, most):
    out = set()
    for grams, tail in states:
        for c in chars:
            text = (tail + c)[-3:]
            out.add((grams | {text} if len(text) == 3 else grams, text[-2:]))
    return out if len(out) <= most else None


def _cut(states):
    return {(grams, "") for grams, _ in states}


def _chars(items) -> set[str] | None:
    """The characters of a small class; None for a large or negated one."""
    out = set()
    for op, arg in items:
        if op == parser.LITERAL:
            out.add(chr(arg).lower())
        elif op == parser.RANGE and arg[1] - arg[0] < 6:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 6 else None


def _walk(items, states, most):
    for op, arg in items:
        if op == parser.LITERAL:
            states = _add(states, {chr(arg).lower()}, most)
        elif op == parser.IN:
            chars = _chars(arg)
            states = _cut(states) if chars is None else _add(states, chars, most)
        elif op == parser.SUBPATTERN:
            states = _walk(arg[-1], states, most)
        elif op == parser.BRANCH:
            ways = [_walk(way, states, most) for way in arg[1]]
            states = None if None in ways else set().union(*ways)
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT):
            least, highest, inner = arg
            if (least, highest) == (0, 1):
                way = _walk(inner, states, most)
                states = None if way is None else states | way
            else:
                for _ in range(min(least, 3)):
                    states = states and _walk(inner, states, most)
                if states and highest != least or least > 3:
                    states = states and _cut(states)
        elif op != parser.AT:
            states = _cut(states)
        if states is None or len(states) > most:
            return None
    return states


# Fixed value: letters from the commonest in English on.
_COMMON = "etaoinshrdlcumwfgypbvkjxqz"


def _rare(gram: str) -> int:
    """Larger for trigrams that texts are likely to lack."""
    return sum(_COMMON.index(c) if c in _COMMON else 2 * len(_COMMON) for c in gram)


def index(docs: DataFrame, rules: tuple[Rule, ...], scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``trigram, doc_id`` for the rules' sets of trigrams, as a written table.

    A set's rarest trigram is looked for first: a text without it gets no postings of
    that set, whose intersection would be empty.
    """
    sets = sorted({tuple(sorted(s, key=lambda t: (-_rare(t), t))) for r in rules for s in alternatives(r.pattern)})
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    asked = F.array(*[F.struct(F.lit(x[0]).alias("first"), strings(x[1:]).alias("more")) for x in sets]).cast("array<struct<first:string,more:array<string>>>")
    lowered = F.array(F.lower(F.col(text_col)))  # in an array, so that it is made once for all trigrams
    own = lambda s: F.flatten(F.transform(F.filter(asked, lambda x: F.contains(s, x["first"])), lambda x: F.concat(F.array(x["first"]), F.filter(x["more"], lambda t: F.contains(s, t)))))
    real = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return scratch.save(real.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(F.transform(lowered, own)[0])).alias("trigram")).select("trigram", "doc_id"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, mask``: bit k is set if the document has all trigrams of one of rule k's sets."""
    spark = postings.sparkSession
    asked = [(k, a, t, len(s)) for k, r in enumerate(rules) for a, s in enumerate(alternatives(r.pattern)) for t in s]
    terms = F.broadcast(spark.createDataFrame(asked, "rule int, way int, trigram string, need int"))  # as many rows as the rules have trigrams
    # rows that repeat an id repeat its postings
    whole = postings.distinct().join(terms, "trigram").groupBy("doc_id", "rule", "way", "need").count().filter("count >= need")
    return whole.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask"))


_SPAN = "array<struct<at:int,rule:int,kind:string,stop:int>>"
#: Matches whose places are summed up in one go; the sums of these groups are summed up in turn.
_GROUP = 256


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """``array<struct<at, rule, kind, stop>>`` of the rule's leftmost non-overlapping matches.

    The text is cut at its matches; a match begins where the lengths of the gaps and
    matches before it end. They are added up in groups, so the work is nearly
    proportional to the matches, however many a text has.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    size = lambda m: F.length(m) if rule.group == 0 else F.length(F.regexp_extract(m, rule.pattern, rule.group))
    cut = lambda ms: F.zip_with(F.slice(gaps, F.lit(1), F.size(ms)), ms, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), (size(m) >= rule.least).alias("ok")))

    def in_groups(p):
        groups = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _GROUP).cast("int"))
        return F.transform(groups, lambda k: F.slice(p, k * _GROUP + 1, F.lit(_GROUP)))

    def placed(group, begin):
        zero = F.struct(begin.cast("int").alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(held, x):
            at = held["at"] + x["gap"]
            stop = (at + x["n"]).cast("int")
            item = F.struct(at.cast("int").alias("at"), F.lit(number).alias("rule"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
            return F.struct(stop.alias("at"), F.when(x["ok"], F.concat(held["out"], F.array(item))).otherwise(held["out"]).alias("out"))

        return F.aggregate(group, zero, step, lambda x: x["out"])

    def begins(groups):
        total = lambda g: F.aggregate(g, F.lit(0), lambda n, x: (n + x["gap"] + x["n"]).cast("int"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(groups, zero, lambda held, g: F.struct((held["at"] + total(g)).cast("int").alias("at"), F.concat(held["out"], F.array(held["at"])).alias("out")), lambda x: x["out"])

    # a variable of a lambda is evaluated once, where an expression would be once a use
    whole = lambda groups: F.flatten(F.zip_with(groups, begins(groups), placed))
    found = F.array(matches)
    for step in (cut, in_groups, whole):
        found = F.transform(found, step)
    found = found[0]
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", postings: DataFrame | None = None) -> DataFrame:
    """``doc_id, found``: all spans ``array<struct<at, rule, kind, stop>>`` of every text, by place, then rule.

    ``postings`` of an earlier ``index`` over the same documents and rules save making
    them anew.
    """
    posted = index(docs, rules, scratch, id_col, text_col) if postings is None else postings
    masks = scratch.save(candidates(posted, rules).select(F.col("doc_id").alias("held_id"), "mask"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    maybe, sure = apart(rows, "doc_id", masks, "held_id", scratch)
    marked = maybe.join(masks, F.col("doc_id") == F.col("held_id"), "left").select("doc_id", "text", "mask").unionByName(sure, allowMissingColumns=True)
    none = F.array().cast(_SPAN)
    found = []
    for k, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, k)
        if alternatives(rule.pattern):
            spans = F.when(F.col("doc_id").isNull() | (F.col("mask").bitwiseAND(F.lit(1 << k)) != 0), spans).otherwise(none)
        found.append(spans)
    return marked.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def digest(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["stop"].cast("string"))), ",")
