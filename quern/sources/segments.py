"""A search index in immutable segments: a refresh writes what has changed, not what there is.

A segment has the ``documents`` that a refresh added or changed (id, hash, vector, length, words and
their counts), which are its postings, too, the ``dead``: ids whose rows in earlier segments count no more, and what all that adds
to the statistics: ``terms`` and ``totals``, where the dead count as less than nothing. The
tables of all segments together are an index as ``retrieval.bm25_search`` takes it. When dead rows or
segments are many, ``compacted`` writes one segment of the living. Which rows are new, gone or living is found
on ids and hashes; texts, vectors and counts stay where they lie (``tables.picked``).

Ids are not null and not repeated; a null text is an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.retrieval import bm25_index, counted, some
from quern.sources.tables import PACKED, content_hash, delete, picked

#: Segments, and share of dead documents, beyond which a refresh compacts.
MOST_SEGMENTS, DEAD_SHARE = 16, 0.25
#: New documents that are brought together; more are counted and written where they lie.
FEW = 10_000
_SCHEMAS = {
    "documents": "id {}, hash string, vector array<double>, dl long, counts map<string,bigint>",
    "dead": "id {}",
    "terms": "term string, df long",
    "totals": "n long, words long",
}


def _read(spark: SparkSession, root: str, segments: list[dict], name: str, kind: str) -> DataFrame:
    """The table of all segments, with the segment's number ``seq``."""
    schema = _SCHEMAS[name].format(kind)
    parts = [spark.read.schema(schema).parquet(f"{root}/{s['name']}/{name}").withColumn("seq", F.lit(s["seq"])) for s in segments]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, seq int")


def _buried(spark: SparkSession, root: str, segments: list[dict], kind: str) -> DataFrame:
    """``id, before``: rows of the id in segments below that number are dead."""
    return _read(spark, root, segments, "dead", kind).groupBy("id").agg(F.max("seq").alias("before"))


def living(rows: DataFrame, dead: DataFrame) -> DataFrame:
    return rows.join(dead.select(F.col("id").alias("_dead"), "before"), (F.col("id") == F.col("_dead")) & (F.col("seq") < F.col("before")), "left_anti")


def tables(spark: SparkSession, root: str, segments: list[dict], kind: str = "string") -> dict[str, DataFrame]:
    """``postings, terms, stats, dead`` for a search, ``vectors (id, vector)``, and ``documents``."""
    read = lambda name: _read(spark, root, segments, name, kind)
    dead = _buried(spark, root, segments, kind)
    documents = living(read("documents"), dead)
    stats = read("totals").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return {
        "postings": read("documents").select("id", F.explode("counts").alias("term", "tf"), F.col("dl").cast("int").alias("dl"), "seq"),
        "dead": dead,
        "terms": read("terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0"),
        "stats": stats.select("n", F.try_divide("words", "n").alias("avgdl")),
        "documents": documents,
        "vectors": documents.select("id", "vector"),
    }


def _write(df: DataFrame, path: str, name: str, *order: str) -> None:
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    laid.write.options(**PACKED).parquet(f"{path}/{name}")


def _save(df: DataFrame, path: str, name: str) -> DataFrame:
    _write(df, path, name)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def _counted(new: DataFrame, embed: Callable[[Column], Column], kind: str, stemmed: bool) -> DataFrame:
    """``documents`` of ``new (id, text, hash)``, whose words are counted where the text lies: ids are not repeated, so nothing is shuffled."""
    schema = _SCHEMAS["documents"].format(kind)
    if stemmed:  # each distinct word is stemmed once and joined back
        own = bm25_index(new, "id", "text", True)["postings"].groupBy("id").agg(F.max("dl").cast("long").alias("dl"), F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("counts"))
        made = new.select("id", "hash", embed(F.col("text")).alias("vector")).join(own, "id", "left")
        return made.select("id", "hash", "vector", F.coalesce("dl", F.lit(0)).alias("dl"), F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"))

    def run(batches):
        for batch in batches:
            words = batch.column(3)
            row, distinct, code, n = counted(words)
            sizes = words.value_lengths().cast(pa.int64())
            offsets = pa.array(np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32))
            counts = pa.MapArray.from_arrays(offsets, distinct.take(pa.array(code)), pa.array(n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), sizes, counts], names=["id", "hash", "vector", "dl", "counts"])

    return new.select("id", "hash", embed(F.col("text")).alias("vector"), T.content_words(F.col("text")).alias("w")).mapInArrow(run, schema)


def refresh(spark: SparkSession, root: str, segments: list[dict], chunks: DataFrame, embed: Callable[[Column], Column], stemmed: bool = False, scope: DataFrame | None = None) -> tuple[list[dict], dict]:
    """The segments that hold ``chunks (chunk_id, text)``: those given and, if anything changed, one more; and counts of what was done.

    With ``scope (id)``, distinct ids, ``chunks`` are those of the scope alone, and what lives outside of it stays.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    asked = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = asked.select(F.col("chunk_id").alias("id"), "text", content_hash().alias("hash"))
    seq = max((s["seq"] for s in segments), default=0) + 1
    name = f"segment-{seq}-{uuid.uuid4().hex[:12]}"
    path = f"{root}/{name}"
    known = _read(spark, root, segments, "documents", kind)
    old = living(known.select("id", "hash", "dl", "seq"), _buried(spark, root, segments, kind))
    if scope is not None:
        old = old.join(scope, "id", "left_semi")
    # a row an id and hash that chunks (came) or segments (seq) have
    both = _save(asked.select("id", "hash", F.lit(True).alias("came")).join(old, ["id", "hash"], "full").select("id", "came", "dl", "seq"), path, "keys") if segments else None
    new = asked
    if segments:
        new = DataFrame.unionByName(*picked(asked, ["id"], both.filter("came and seq is null"), both.filter("came and seq is not null")))
        if both.filter("came and seq is null").limit(FEW).count() < FEW:
            new = new.repartition("id")
    _write(_counted(new, embed, kind, stemmed), path, "documents")
    documents = spark.read.schema(_SCHEMAS["documents"].format(kind)).parquet(f"{path}/documents")
    gone = both.filter("came is null") if segments else old
    _write(gone.select("id"), path, "dead")
    lost = some(known, "id", gone, "id").join(gone.select("id", "seq"), ["id", "seq"], "left_semi")
    terms = lambda df, n: df.select(F.explode(F.map_keys("counts")).alias("term")).groupBy("term").agg((n * F.count("*")).alias("df"))
    _write(terms(documents, 1).unionByName(terms(lost, -1)).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0"), path, "terms", "term")
    count = lambda df: df.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    (added, words), (removed, fewer) = count(documents), count(gone)
    _write(spark.createDataFrame([(added - removed, words - fewer)], _SCHEMAS["totals"]), path, "totals")
    delete(spark, f"{path}/keys")
    report = {"added": added, "removed": removed, "segments": len(segments) + bool(added or removed)}
    if not added and not removed:
        delete(spark, path)
        return segments, report
    held = [*segments, {"name": name, "seq": seq, "added": added, "removed": removed}]
    rows, dead = sum(s["added"] for s in held), sum(s["removed"] for s in held)
    if len(held) > MOST_SEGMENTS or dead > DEAD_SHARE * rows:
        held = compacted(spark, root, held, kind)
        delete(spark, path)  # no version names it
        report["segments"] = len(held)
    return held, report


def compacted(spark: SparkSession, root: str, segments: list[dict], kind: str = "string") -> list[dict]:
    """One segment of all that lives in ``segments``."""
    whole = tables(spark, root, segments, kind)
    seq = max(s["seq"] for s in segments) + 1
    name = f"segment-{seq}-{uuid.uuid4().hex[:12]}"
    path = f"{root}/{name}"
    known, dead = _read(spark, root, segments, "documents", kind), whole["dead"].withColumnRenamed("id", "_dead")
    keys = _save(known.select("id", "seq").join(dead, F.col("id") == F.col("_dead"), "left").select("id", "seq", F.coalesce(F.col("seq") < F.col("before"), F.lit(False)).alias("buried")), path, "keys")
    _write(DataFrame.unionByName(*picked(known, ["id", "seq"], keys.filter("not buried"), keys.filter("buried"))).drop("seq"), path, "documents")
    delete(spark, f"{path}/keys")
    _write(spark.createDataFrame([], _SCHEMAS["dead"].format(kind)), path, "dead")
    _write(whole["terms"], path, "terms", "term")
    _write(_read(spark, root, segments, "totals", kind).agg(F.sum("n").alias("n"), F.sum("words").alias("words")), path, "totals")
    rows = spark.read.parquet(f"{path}/documents").count()
    return [{"name": name, "seq": seq, "added": rows, "removed": 0}]
