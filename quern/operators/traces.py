"""Query traces: upsert, recent, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranges import part_of


def upsert(traces: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The latest row of each key, as insert-or-replace leaves it."""
    latest = Window.partitionBy(key).orderBy(*order)
    return traces.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def recent(traces: DataFrame, ts: str, key: str, n: int = 50) -> DataFrame:
    return traces.orderBy(F.desc(ts), key).limit(n)


def at_index(traces: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each share p the sorted value at place min(n-1, int(p*n)).

    Values are counted, their running counts are kept in two levels (even ranges of the
    distinct values), so no task sorts them all.
    """
    counts = traces.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).count()
    total = counts.agg(F.sum("count").alias("n"))  # one row
    ranged = counts.withColumn("part", part_of(counts, "v"))
    parts = ranged.groupBy("part").agg(F.sum("count").alias("pn"))
    before = parts.select("part", (F.sum("pn").over(Window.partitionBy(F.lit(1)).orderBy("part")) - F.col("pn")).alias("before"))  # a row a range
    inner = Window.partitionBy("part").orderBy("v")
    placed = ranged.crossJoin(F.broadcast(total)).join(F.broadcast(before), "part").withColumn("end", F.col("before") + F.sum("count").over(inner)).withColumn("start", F.col("end") - F.col("count"))
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))
    pick = lambda p: F.max(F.when((F.col("start") <= at(p)) & (at(p) < F.col("end")), F.col("v")))
    return placed.agg(*[F.round(pick(p), 1).alias(name) for name, p in shares.items()])


def stats(traces: DataFrame, refused: Column, latency: str, first_token: Column | None = None) -> DataFrame:
    """One row: number, refusal rate, latencies at .5 and .95, mean time to the first token."""
    whole = traces.agg(F.count("*").alias("total_traces"), F.round(F.coalesce(F.avg(refused.cast("int")), F.lit(0.0)), 4).alias("refusal_rate"), F.round(F.avg(F.lit(None).cast("double") if first_token is None else first_token), 1).alias("avg_first_token_ms"))
    return whole.crossJoin(F.broadcast(at_index(traces, latency, {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})))


def top_cited(traces: DataFrame, cited: Column, n: int = 10) -> DataFrame:
    """The most cited, ties by name."""
    return traces.select(F.explode(cited).alias("section_id")).groupBy("section_id").count().orderBy(F.desc("count"), "section_id").limit(n)
