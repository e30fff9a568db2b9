"""Mixing sources to target weights by temperature.

Token shares p are raised to an exponent and normalised: w ~ p^a, natural shares at
a = 1, equal ones at a = 0. ``temper`` bisects a until the weights' entropy reaches a
target (as a share of the largest entropy) or no source is repeated more than a limit.
``schedule`` realises the weights: a source's documents are dealt by hash into blocks
of about ``block_tokens`` tokens, each pass over a source is another permutation of
its blocks, and passes go on until the source's budget is met, to a block. ``at`` in
[0, 1) is a block's place in the whole run; in any stretch of it the sources stand in
the target weights.

Everything is grouped sums: of tokens by source (combined before the shuffle) and by
block, with running sums in two levels so that a source of any size has no large
window. Tokens are words here (runs of non-space characters). Tables of sources and of
blocks are joined without hints: Spark broadcasts them while their size allows it.

Null texts have no tokens; a null source is a source of its own. Sources without
tokens are given once. Rows that repeat are dealt to the same block. With an empty
table the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.llm.common import Scratch


@dataclass(frozen=True)
class Params:
    #: Reach this share of log(number of sources), or None.
    entropy: float | None = None
    #: The most passes over a source, or None; with no budget given, against one pass over the least repeated.
    repeats: float | None = 2.0
    #: Tokens to give, or None: as many as give every document at least once.
    budget: int | None = None
    block_tokens: int = 100_000
    seed: int = 1


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("\x00null"))


def temper(sizes: DataFrame, params: Params = Params()) -> float:
    """The largest exponent, to 2^-32, that meets the entropy target and the repetition limit.

    Both get easier to meet as the exponent falls for entropy, and as it rises for
    repetition; entropy wins where they conflict. Each round tries 17 exponents at once.
    """
    real = sizes.filter("tokens > 0")
    one_pass = F.lit(params.budget).cast("double") if params.budget else F.max(F.col("tokens") / F.col("w"))

    def measured(lo: float, hi: float):
        grid = real.select("tokens", F.explode(F.array(*[F.lit(lo + (hi - lo) * k / 16) for k in range(17)])).alias("a"))
        power = F.exp(F.col("a") * F.log("tokens"))
        norm = grid.groupBy("a").agg(F.sum(power).alias("all"), F.count("*").alias("k"))
        w = grid.join(norm, "a").withColumn("w", power / F.col("all"))
        by = w.groupBy("a", "k").agg((-F.sum(F.col("w") * F.log("w"))).alias("h"), one_pass.alias("budget"), F.max(F.col("w") / F.col("tokens")).alias("dense"))
        return by.select("a", (F.col("h") / F.log(F.greatest("k", F.lit(2)))).alias("h"), (F.col("budget") * F.col("dense")).alias("r")).orderBy("a").collect()

    def bisect(good, first_good: bool) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(8):
            rows = measured(lo, hi)
            ok = [r["a"] for r in rows if good(r)]
            if not ok:
                return lo if not first_good else hi
            if first_good:  # the smallest that is good
                hi, lo = ok[0], max([r["a"] for r in rows if r["a"] < ok[0]], default=ok[0])
            else:
                lo, hi = ok[-1], min([r["a"] for r in rows if r["a"] > ok[-1]], default=ok[-1])
            if lo == hi:
                break
        return hi if first_good else lo

    if params.entropy is not None:
        return bisect(lambda r: r["h"] >= params.entropy - 1e-12, False)
    if params.repeats is not None:
        return bisect(lambda r: r["r"] <= params.repeats + 1e-9, True)
    return 1.0


def plan(docs: DataFrame, scratch: Scratch, params: Params = Params(), source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source, tokens, weight, passes, n_blocks`` for each source, as a written table."""
    sizes = scratch.save(docs.groupBy(source_of(F.col(source_col)).alias("source")).agg(F.sum(tokens(F.col(text_col))).alias("tokens")))
    a = temper(sizes, params)
    power = F.when(F.col("tokens") > 0, F.exp(F.lit(a) * F.log(F.greatest("tokens", F.lit(1))))).otherwise(0.0)
    total = sizes.agg(F.sum(power).alias("all"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / power)).alias("least"))
    weight = F.when(F.col("all") > 0, power / F.col("all")).otherwise(0.0)
    budget = F.lit(params.budget).cast("double") if params.budget else F.col("least") * F.col("all")
    # the limit holds to 1e-9, so a digit less than that
    passes = F.when(F.col("tokens") > 0, F.round(weight * budget / F.col("tokens"), 7)).otherwise(F.lit(1.0))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / params.block_tokens)).cast("long")
    # total is one row
    return scratch.save(sizes.join(F.broadcast(total), F.lit(True)).select("source", "tokens", weight.alias("weight"), passes.alias("passes"), blocks.alias("n_blocks")))


def _with_blocks(docs: DataFrame, sources: DataFrame, params: Params, id_col: str, source_col: str, text_col: str, keep: list[Column]) -> DataFrame:
    rows = docs.select(*keep, F.col(id_col).alias("_id"), source_of(F.col(source_col)).alias("source"), F.xxhash64(F.lit(params.seed), F.col(id_col), F.col(text_col)).alias("_h"))
    return rows.join(sources.select("source", "n_blocks"), "source").withColumn("block", F.pmod("_h", "n_blocks"))


def schedule(docs: DataFrame, sources: DataFrame, scratch: Scratch, params: Params = Params(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source, block, visits array<struct<epoch, at>>``: when each block is given."""
    dealt = _with_blocks(docs, sources, params, id_col, source_col, text_col, [tokens(F.col(text_col)).alias("_n")])
    sums = scratch.save(dealt.groupBy("source", "block").agg(F.sum("_n").alias("n")))
    passes = sums.join(sources.select("source", "tokens", "passes"), "source").select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes").cast("int") - 1, F.lit(0)))).alias("epoch"))
    placed = passes.withColumn("h", F.xxhash64(F.lit(params.seed), "source", "epoch", "block")).withColumn("part", F.shiftrightunsigned("h", 54))
    parts = placed.groupBy("source", "epoch", "part").agg(F.sum("n").alias("pn"))
    before = parts.select("source", "epoch", "part", (F.sum("pn").over(Window.partitionBy("source", "epoch").orderBy("part")) - F.col("pn")).alias("before"))
    # h is signed; its unsigned order is that of h xor the sign bit
    order = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    inner = F.sum("n").over(Window.partitionBy("source", "epoch", "part").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1))
    run = placed.join(before, ["source", "epoch", "part"]).withColumn("done", F.col("before") + F.coalesce(inner, F.lit(0)))
    share = F.when(F.col("tokens") > 0, F.col("done") / F.col("tokens")).otherwise(0.0)
    # a whole pass gives every block, those without tokens behind its last token too
    whole = F.col("epoch") + 1 <= F.col("passes")
    given = run.withColumn("upto", F.col("epoch") + share).filter((F.col("upto") < F.col("passes")) | whole | (F.col("tokens") == 0))
    at = F.least(F.col("upto") / F.col("passes"), F.lit(1 - 2.0**-53))
    visits = given.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", at.alias("at")))).alias("visits"))
    return scratch.save(visits)


def mix(docs: DataFrame, scratch: Scratch, params: Params = Params(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns), ``source, block, epoch, at, weight``: each time that a document is given."""
    sources = plan(docs, scratch, params, source_col, text_col)
    times = schedule(docs, sources, scratch, params, id_col, source_col, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    dealt = _with_blocks(docs, sources, params, id_col, source_col, text_col, [row])
    given = dealt.join(times, ["source", "block"]).select("row", "source", "block", F.explode("visits").alias("v"))
    return given.join(sources.select("source", "weight"), "source").select("row", "source", "block", "v.epoch", "v.at", "weight")


def mixed_documents(docs: DataFrame, scratch: Scratch, params: Params = Params(), **columns: str) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, each as often as it is given."""
    given = mix(docs, scratch, params, **columns)
    return given.repartitionByRange("at", F.xxhash64("source", "block", "epoch")).sortWithinPartitions("at").select("row.*")
