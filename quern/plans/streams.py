"""Queries whose tables come from streams, in three arrivals with a restart between them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas
from quern.engine import Engine
from quern.plans.corpus import _sections
from quern.plans.registry import ORACLES, query
from quern.sources import changes, segments
from quern.sources.tables import PACKED, content_hash, delete, parquet, work_dir
from quern.streaming.ingest import DailyTraces, sections_into


@query(ORACLES["chunk_greedy"])
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that corpus and index hold alike after the documents came as a stream: some with earlier texts, some
    that are removed, some twice in a batch, of which the later counts."""
    root = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    engine, number = Engine(spark, f"{root}/store"), F.col("section_id").cast("long")
    docs = _sections(spark, sf_dir).withColumn("n", F.lit(2)).withColumn("removed", F.lit(False))
    early = docs.withColumn("text", F.concat(F.lit("An earlier text. "), "text")).withColumn("n", F.lit(1))
    gone = docs.filter(number % 5 == 0).withColumn("section_id", F.concat(F.lit("gone-"), "section_id"))
    arrivals = (
        early.filter((number % 3 != 2) & (number % 2 == 0)).unionByName(docs.filter((number % 3 != 2) & (number % 2 == 1))).unionByName(gone),
        early.filter(number % 3 == 2).unionByName(docs.filter((number % 3 == 2) | (number % 2 == 0))),
        gone.withColumn("removed", F.lit(True)),
    )
    for rows in arrivals:
        rows.write.mode("append").options(**PACKED).parquet(f"{root}/in")
        stream = spark.readStream.schema(f"{schemas.SECTION}, n int, removed boolean").parquet(f"{root}/in")
        sections_into(engine, stream, "documents", f"{root}/at", "n").awaitTermination()
        delete(spark, f"{root}/in")  # its batch is published
    state = engine._state()
    held = segments.tables(spark, engine.root, state["segments"])["documents"].select(F.col("id").alias("chunk_id"), "hash")
    # digests are joined, not texts
    made = changes.read(spark, engine.root, state["corpus"], state["changes"], "chunks", "chunk_id", "chunk_idx", content_hash().alias("hash"), F.md5("text").alias("text"))
    return made.join(held, ["chunk_id", "hash"]).select("chunk_id", "chunk_idx", "text")


@query(ORACLES["trace_upsert"])
def trace_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trace_upsert`` on a table by day that the events come to as a stream, the latest not last."""
    root = f"{work_dir(spark)}/traces-{uuid.uuid4().hex}"
    schema = "user_id long, event_id long, ts timestamp, value double"
    table = DailyTraces(spark, f"{root}/store", schema, "user_id", order=("event_id",))
    events = parquet(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    for part in (1, 2, 0):
        events.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{root}/in")
        table.traces_into(spark.readStream.schema(schema).parquet(f"{root}/in"), "events", f"{root}/at").awaitTermination()
    kind = parquet(spark, sf_dir, "events").schema["ts"].dataType
    return table.read().select("user_id", "event_id", F.col("ts").cast(kind).alias("ts"), "value")
