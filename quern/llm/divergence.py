"""Source divergence audit: how far the sources of a language are from each other, and which terms make a source stand out.

Terms are runs of ASCII letters and other characters than ASCII, A-Z in lower case.
``term_counts`` counts them in numpy over whole batches, by the UTF-8 bytes;
``vocabulary`` keeps a language's terms that enough of its documents have, each with
its counts by source. A share is ``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``, the
divergence of two shares ``floor((p - q)^2 / (p + q))``; all of it is integers.

``pairs`` sums the divergence over all kept terms for two sources without visiting the
terms that neither has: where both lack a term they differ by a baseline that is
the same for all such terms. A term that one source has corrects it - summed over the
distinct shares of a source, not over its terms - and a term that both have is corrected again;
those are counted inside the task that holds the term's list of sources.

``largest`` ranks by radix selection: histograms over the leading bits of the values
find the bin that holds each group's kth value, only that bin is refined with the next
bits, and values that tie with the kth are refined by the bytes of their items, twice as many each
time. A group's rows are dealt out over SALTS parts, and no task sees all of a group.

Null text, language and source are ''. Rows that repeat are documents of their own. A
language without kept terms has pairs of value 0. An empty table gives no rows. Only
text, lang and source are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, utf8
from quern.llm.packing import by_bytes

SCALE = 1_000_000_000
#: Bytes of text counted at once; rows of counts that a task holds before it adds them up; pairs of sources at once.
SLICE_BYTES, HELD_ROWS, PAIR_ROWS = 8 << 20, 1_000_000, 1 << 20
#: Bits of a value that one histogram tells apart, and parts of a group's rows.
BITS, SALTS = 16, 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in a row, and the text of each."""
    data, off = utf8(column)
    inside = _TERM[data]
    # a term also ends where its text ends
    begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    first = off[:-1][(off[:-1] < off[1:])]
    begins = np.union1d(begins, first[inside[first]]) if len(data) else begins
    stops = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1 if len(data) else begins
    last = off[1:][(off[:-1] < off[1:])]
    stops = np.union1d(stops, last[inside[last - 1]]) if len(data) else stops
    cuts = np.concatenate(([0], np.cumsum(stops - begins))).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(cuts.tobytes()), pa.py_buffer(_LOWER[data[inside]].tobytes()))
    return terms, np.searchsorted(off, begins, "right") - 1


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, occ, docs``: occurrences and documents, in part sums by task."""
    names = ["lang", "source", "term"]

    def added(held):
        return pa.concat_tables(held).group_by(names).aggregate([("occ", "sum"), ("docs", "sum")]).rename_columns([*names, "occ", "docs"])

    def counted(batch):
        terms, doc = _terms(batch.column(2))
        coded = terms.dictionary_encode()
        code, n = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
        groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        keys = pc.binary_join_element_wise(pc.utf8_length(batch.column(0)).cast(pa.string()), batch.column(0), batch.column(1), ":").dictionary_encode()
        group = keys.indices.to_numpy()
        pair, occ = np.unique(doc * n + code, return_counts=True)
        key, back = np.unique(group[pair // n] * n + pair % n, return_inverse=True)
        total, documents = np.zeros(len(key), np.int64), np.bincount(back, minlength=len(key))
        np.add.at(total, back, occ)
        example = np.zeros(len(keys.dictionary), np.int64)
        example[group] = np.arange(batch.num_rows)
        own = groups.take(pa.array(example[key // n]))
        return pa.table([own.field(0), own.field(1), coded.dictionary.cast(pa.string()).take(pa.array(key % n)), pa.array(total), pa.array(documents.astype(np.int64))], names=[*names, "occ", "docs"])

    def run(batches):
        held, rows = [], 0
        for batch in by_bytes(batches, 2, SLICE_BYTES):
            made = counted(batch)
            held, rows = [*held, made], rows + made.num_rows
            if rows > HELD_ROWS:
                whole = added(held)
                held, rows = [whole], whole.num_rows
                if rows > HELD_ROWS // 2:
                    yield from whole.to_batches(100_000)
                    held, rows = [], 0
        if held:
            yield from added(held).to_batches(100_000)

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")).mapInArrow(run, "lang string, source string, term string, occ long, docs long")


def vocabulary(counts: DataFrame, least_docs: int) -> DataFrame:
    """``lang, term, total, by_source array<struct<source, occ>>`` of the terms that ``least_docs`` documents of the language have."""
    dealt = counts.repartition("lang", "term")  # both sums below stay there
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("occ").alias("occ"), F.sum("docs").alias("docs"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("occ").alias("total"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "occ"))).alias("by_source"))
    return terms.filter(F.col("docs") >= least_docs).drop("docs")


def _share(count: Column, room: Column) -> Column:
    """``room`` is the total and twice the number of terms; decimals, since the product may pass 64 bits."""
    whole = F.call_function("div", (count + 2).cast("decimal(27,0)") * F.lit(SCALE).cast("decimal(10,0)"), room.cast("decimal(20,0)"))
    return 1 + whole


def apartness(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(docs: DataFrame, terms: DataFrame, scratch: Scratch, lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``groups (lang, source, room, zero)`` of every group that occurs, and ``rows (lang, source, term, p, zero, q)``; ``zero`` is the share of a term that the group lacks."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), (F.sum("total") + 2 * F.count("*")).alias("room"))
    each = terms.select("lang", "term", "total", F.explode("by_source").alias("s")).select("lang", "term", "total", "s.source", "s.occ")
    sums = each.groupBy("lang", "source").agg(F.sum("occ").alias("n"))
    occurring = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    groups = occurring.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    # without kept terms a language has no room: one, for shares that nothing adds up
    own_room = F.greatest(F.coalesce("n", F.lit(0)) + 2 * F.coalesce("terms", F.lit(0)), F.lit(1))
    groups = scratch.save(groups.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), own_room.alias("room"), F.coalesce("room", F.lit(1)).alias("lang_room")))
    groups = groups.withColumn("zero", _share(F.lit(0), F.col("room")))
    rows = each.join(groups, ["lang", "source"]).select("lang", "source", "term", _share(F.col("occ"), F.col("room")).alias("p"), "zero", _share(F.col("total"), F.col("lang_room")).alias("q"))
    return groups, scratch.save(rows)


def _met(rows: DataFrame) -> DataFrame:
    """``lang, source, other, value``: over the terms that both have, what their divergence adds to that of each with the other's baseline."""

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            first = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
            flat = lists.flatten()
            lang, name = batch.column(0).dictionary_encode(), flat.field(0).dictionary_encode()
            p, zero = flat.field(1).to_numpy(), flat.field(2).to_numpy()
            source, n = name.indices.to_numpy().astype(np.int64), max(1, len(name.dictionary))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            later = first[row + 1] - np.arange(len(row)) - 1  # partners behind each in its list
            sums: dict[int, int] = {}
            at, upto = 0, np.concatenate(([0], np.cumsum(later)))
            while at < len(row):
                end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIR_ROWS, "right")) - 1)
                i = np.repeat(np.arange(at, end), later[at:end])
                j = i + 1 + np.arange(len(i)) - np.repeat(upto[at:end] - upto[at], later[at:end])
                value = f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
                key = (lang.indices.to_numpy()[row[i]] * n + source[i]) * n + source[j]
                order = np.argsort(key, kind="stable")
                keys, starts = np.unique(key[order], return_index=True)
                if len(keys):
                    for k, v in zip(keys.tolist(), np.add.reduceat(value[order], starts).tolist()):
                        sums[k] = sums.get(k, 0) + v
                at = end
            keys = np.fromiter(sums, np.int64, len(sums))
            columns = [lang.dictionary.take(pa.array(keys // n // n)), name.dictionary.take(pa.array(keys // n % n)), name.dictionary.take(pa.array(keys % n)), pa.array(list(sums.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "other", "value"])

    lists = rows.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "zero"))).alias("s"))
    return lists.select("lang", "s").mapInArrow(run, "lang string, source string, other string, value long")


def pairs(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the divergence of each source from each other source of its language."""
    swapped = lambda df: df.unionByName(df.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    base = groups.join(other, "lang").filter("source <> other").select("lang", "source", "other", (F.col("terms") * apartness(F.col("zero"), F.col("other_zero"))).alias("value"))
    # a source's terms by their distinct shares
    levels = rows.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("n"))
    single = levels.join(other, "lang").filter("source <> other")
    single = single.groupBy("lang", "source", "other").agg(F.sum(F.col("n") * (apartness(F.col("p"), F.col("other_zero")) - apartness(F.col("zero"), F.col("other_zero")))).alias("value"))
    whole = base.unionByName(swapped(single)).unionByName(swapped(_met(rows)))
    return whole.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")).withColumnRenamed("other", "item")


def largest(rows: DataFrame, by: list[str], k: int, scratch: Scratch, item: str = "item", value: str = "value") -> DataFrame:
    """The ``k`` rows of each group with the largest values, ties to the smaller item by its UTF-8 bytes; with ``rank``.

    Values are not negative; items are told apart within a group. Groups may be of any size.
    """
    columns = rows.columns
    live = scratch.save(rows.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(SALTS))).withColumn("_need", F.lit(k).cast("long")))
    top = live.agg(F.max(value)).first()[0]
    if top is None:
        return rows.withColumn("rank", F.lit(1)).filter("false")
    taken = []
    for shift in range((max(1, top.bit_length()) - 1) // BITS * BITS, -1, -BITS):
        live = _refined(live, by, F.shiftright(value, shift).bitwiseAND(F.lit((1 << BITS) - 1)), True, scratch, taken)
    at, width = 1, 8
    while not live.isEmpty():
        live = _refined(live, by, F.substring(F.col(item).cast("binary"), at, width), False, scratch, taken)
        at, width = at + width, width * 2
    whole = taken[0]
    for more in taken[1:]:
        whole = whole.unionByName(more)
    # at most k rows of a group are left
    order = Window.partitionBy(*by).orderBy(F.desc(value), item)
    return whole.select(columns).withColumn("rank", F.row_number().over(order))


def _refined(live: DataFrame, by: list[str], digit: Column, descending: bool, scratch: Scratch, taken: list[DataFrame]) -> DataFrame:
    """Adds the rows before each group's cutting bin to ``taken``; gives those in it. Where a bin ends just at the kth row it is taken, too."""
    rows = live.withColumn("_digit", digit)
    bins = rows.groupBy(*by, "_digit").agg(F.count("*").alias("_n"), F.max("_need").alias("_need"))
    order = Window.partitionBy(*by).orderBy(F.desc("_digit") if descending else F.asc("_digit"))
    upto = F.sum("_n").over(order)
    bins = bins.withColumn("_before", upto - F.col("_n")).filter("_before < _need")
    bins = bins.select(*by, "_digit", F.when(F.col("_before") + F.col("_n") > F.col("_need"), F.col("_need") - F.col("_before")).alias("_left"))
    bins = scratch.save(bins.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_salt", F.col("_salt").cast("long")))
    held = scratch.save(rows.join(bins, [*by, "_digit", "_salt"]))
    taken.append(held.filter("_left is null").drop("_digit", "_left", "_need"))
    return held.filter("_left is not null").drop("_need", "_digit").withColumnRenamed("_left", "_need")


def audit(docs: DataFrame, scratch: Scratch, least_docs: int = 10, ranks: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has every other source, part ``term`` the first ``ranks`` terms that a source has more of than its language."""
    terms = scratch.save(vocabulary(term_counts(docs, text_col, lang_col, source_col), least_docs))
    groups, rows = shares(docs, terms, scratch, lang_col, source_col)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = pairs(groups, rows).withColumn("rank", F.row_number().over(order))
    more = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), apartness(F.col("p"), F.col("q")).alias("value"))
    best = largest(more, ["lang", "source"], ranks, scratch)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return scratch.only(columns(apart, "pair").unionByName(columns(best, "term")))
