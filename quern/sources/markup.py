"""Regulation files in parts: one file is read by as many tasks as it has splits.

Spark's text source cuts a file at every opening of a division, so a row is what stands from one opening to
the next, wherever the splits of the file are. Each row is cut further where divisions close;
such a piece is whole markup by itself, and Python reads the paragraphs and table rows
of one piece at a time. What is open at a piece - the part, subpart, group of subjects and unit it lies
in - is the last opening of each level that no closing follows. That is carried in two steps: within a
split, and from split to split by the last state of each, so no task walks a whole file.

Markup that hides a division's tag in a comment or in literal text is not supported, nor a division
without an inside (``<DIV8/>``), nor names with a prefix.
"""

from __future__ import annotations

from html import unescape
from xml.etree.ElementTree import ParseError, fromstring

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.cleaning import PARAGRAPHS, SKIPPED, UNITS, words_of

#: Where a row lies: split, row within what its task reads, piece of the row.
ORDER = ["split", "row", "piece"]
_LEVELS = range(1, 10)
_OPENED = "struct<type:string,n:string,head:string,split:bigint,row:bigint,piece:int>"


def _blocks(node, found: list[str], in_table: bool = False) -> None:
    """The paragraphs and table rows of a piece, in order; what is inside of one, or of skipped markup, is none of its own."""
    for child in node:
        name = child.tag
        if name in PARAGRAPHS:
            if not in_table and (text := words_of(child)):
                found.append(text)
        elif name == "TR" and in_table:
            if row := " | ".join(filter(None, (words_of(cell) for cell in child if cell.tag in ("TH", "TD")))):
                found.append(row)
        elif name == "GPOTABLE":
            if not in_table:
                _blocks(child, found, True)
        elif name not in SKIPPED:
            _blocks(child, found, in_table)


def _read(pieces):
    """``head`` and ``blocks`` of the markup of each piece."""
    for table in pieces:
        heads, blocks = [], []
        for opens, markup in zip(table["opens"], table["markup"]):
            found, head = [], ""
            try:
                root = fromstring(f"<x>{markup}</x>")
            except ParseError:  # before the first division, behind the last, and markup that is broken
                root = None
            if root is not None and opens:
                head = next((t for h in root.iter("HEAD") if (t := (h.text or "").strip())), "")
            if root is not None:
                _blocks(root, found)
            heads.append(head)
            blocks.append(found)
        yield table.drop(columns="markup").assign(head=heads, blocks=blocks)


def pieces(spark: SparkSession, path: str, names: str = "*.xml") -> DataFrame:
    """``path, split, row, piece, level, opens, type, n, head, blocks``: a piece that opens a division of ``level``, or stands behind its closing."""
    rows = spark.read.option("lineSep", "<DIV").option("pathGlobFilter", names).text(path)
    # within a split the rows are numbered as they are read; a task's number is the same for all rows of a split
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    tag = F.regexp_extract("value", r"^[1-9](?:\s[^>]*)?>", 0)
    named = lambda a: F.regexp_extract(tag, rf"""\s{a}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 0)
    plain = lambda a: F.regexp_replace(named(a), r"""^\s\w+\s*=\s*["']|["']$""", "")
    inner = F.when(tag != "", F.substring("value", F.length(tag) + 1, F.length("value"))).otherwise(F.col("value"))
    # a piece behind a closing begins with its level
    cut = rows.select("path", "split", "row", tag.alias("tag"), plain("TYPE").alias("type"), plain("N").alias("n"), F.posexplode(F.split(inner, r"</DIV(?=[1-9]\s*>)")).alias("piece", "text"))
    closing = F.regexp_extract("text", r"^([1-9])\s*>", 1)
    opens = (F.col("piece") == 0) & (F.col("tag") != "")
    level = F.when(opens, F.substring("tag", 1, 1)).otherwise(F.nullif(closing, F.lit(""))).cast("int")
    markup = F.when(F.col("piece") == 0, F.col("text")).otherwise(F.regexp_replace("text", r"^[1-9]\s*>", ""))
    own = cut.filter(opens | (F.col("piece") > 0)).select("path", "split", "row", "piece", level.alias("level"), opens.alias("opens"), "type", "n", markup.alias("markup"))
    return own.mapInPandas(_read, "path string, split long, row long, piece int, level int, opens boolean, type string, n string, head string, blocks array<string>")


def _unescaped(c: str) -> Column:
    return F.pandas_udf(lambda x: x.map(unescape), "string")(F.coalesce(F.col(c), F.lit("")))


def _carried(events: DataFrame) -> DataFrame:
    """``events (path, split, row, piece, e1 ... e9)`` with the last event of each level, this piece's own included, as ``e1 ... e9``."""
    names = [f"e{k}" for k in _LEVELS]
    last = lambda w: [F.last(n, ignorenulls=True).over(w).alias(n) for n in names]
    within = Window.partitionBy("path", "split").orderBy("row", "piece")
    inside = events.select(*[c for c in events.columns if c not in names], *last(within))
    ends = events.groupBy("path", "split").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.struct("row", "piece"))).alias(n) for n in names])
    # a row a split
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("path", "split", *[F.last(n, ignorenulls=True).over(before).alias(f"c{n}") for n in names])
    joined = inside.join(carried, ["path", "split"])
    return joined.select(*[c for c in events.columns if c not in names], *[F.coalesce(n, f"c{n}").alias(n) for n in names])


def units(spark: SparkSession, path: str, names: str = "*.xml") -> DataFrame:
    """Sections and appendices as ``cleaning.UNIT`` has them, with ``path`` and, in the place of ``ord``, where each closes: ORDER."""
    held = pieces(spark, path, names).withColumns({"type": _unescaped("type"), "n": _unescaped("n")})
    opened = F.struct("type", "n", "head", *ORDER).cast(_OPENED)
    closed = F.lit(None).cast(_OPENED)
    # an event is an array: of what was opened, or of null where the level was closed
    event = lambda k: F.when(F.col("level") == k, F.array(F.when(F.col("opens"), opened).otherwise(closed)))
    state = _carried(held.select("path", *ORDER, "blocks", "level", "opens", *[event(k).alias(f"e{k}") for k in _LEVELS]))
    open_now = F.filter(F.array(*[F.get(f"e{k}", F.lit(0)) for k in reversed(_LEVELS)]), lambda x: x.isNotNull())
    names = {(f"DIV{k}", t) for k, t in ((8, "SECTION"), (8, "APPENDIX"), (9, "SECTION"), (9, "APPENDIX"))} & UNITS
    is_unit = lambda k: F.get(f"e{k}", F.lit(0))["type"].isin(*[t for d, t in names if d == f"DIV{k}"])
    unit = F.when(is_unit(9), F.get("e9", F.lit(0))).when(is_unit(8), F.get("e8", F.lit(0)))
    above = lambda t: F.get(F.filter(open_now, lambda x: x["type"] == t), F.lit(0))
    own = state.select("path", *ORDER, "blocks", "opens", unit.alias("unit"), above("PART").alias("part"), above("SUBPART").alias("subpart"), above("SUBJGRP").alias("subject")).filter("unit is not null")
    key = F.col("unit").dropFields("type", "n", "head")
    at = F.struct(*ORDER)
    # a unit has a piece for each division that opens or closes within it; where it opens, what is above it is open
    grouped = own.groupBy("path", key.alias("key"), F.col("unit.type").alias("type"), F.col("unit.n").alias("number"), F.col("unit.head").alias("head")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "blocks"))), lambda x: x["blocks"])).alias("blocks"),
        F.max(F.when(F.col("opens"), F.struct("part", "subpart", "subject"))).alias("above"),
        F.max(at).alias("last"),
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    subpart = F.coalesce(F.nullif(F.col("above.subpart.head"), F.lit("")), F.trim("above.subpart.n"))
    return grouped.select("path", *[F.col(f"last.{c}").alias(c) for c in ORDER], "type", "number", text(F.col("above.part.n")).alias("part_number"), text(subpart).alias("subpart"), text(F.col("above.subject.head")).alias("subject"), "head", F.trim(F.array_join("blocks", "\n")).alias("text"))
