"""Sections and chunks as a base and changes to it: a batch writes its own sections, not the corpus.

A change is a folder of its own with the batch's ``sections``, their ``chunks``, and the ids it ``touched``
(new, changed or removed). A row counts if no later change touched its section. ``merged`` writes
a base of what counts, once there are more than MOST changes.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas
from quern.config import Settings
from quern.operators import chunking
from quern.sources import tables

MOST = 16
_SCHEMAS = {"sections": schemas.SECTION, "chunks": schemas.CHUNK, "touched": "section_id string"}


def _part(spark: SparkSession, root: str, folder: str, name: str, seq: int) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{root}/{folder}/{name}").withColumn("_seq", F.lit(seq))


def read(spark: SparkSession, root: str, base: str | None, changes: list[str], name: str, *columns: Column | str) -> DataFrame:
    """``sections`` or ``chunks`` of a base (its folder; None: empty) and the folders of changes, in their order; or ``columns`` of them, which are made before any row is shuffled."""
    parts = ([_part(spark, root, base, name, 0)] if base else []) + [_part(spark, root, c, name, k + 1) for k, c in enumerate(changes)]
    if not parts:
        rows = spark.createDataFrame([], _SCHEMAS[name])
        return rows.select(*columns) if columns else rows
    rows = reduce(DataFrame.unionByName, [p.select(*(columns or [c for c in p.columns if c != "_seq"]), F.col("section_id").alias("_own"), "_seq") for p in parts])
    if changes:
        touched = reduce(DataFrame.unionByName, [_part(spark, root, c, "touched", k + 1) for k, c in enumerate(changes)])
        last = touched.groupBy(F.col("section_id").alias("_id")).agg(F.max("_seq").alias("_last"))
        rows = rows.join(last, (F.col("_own") == F.col("_id")) & (F.col("_seq") < F.col("_last")), "left_anti")
    return rows.drop("_own", "_seq")


_FIELDS = [f.split()[0] for f in schemas.SECTION.split(", ")]


def plain(rows: DataFrame, order: str | None = None) -> DataFrame:
    """SECTION, ``removed`` and ``_order`` of ``rows`` (SECTION, perhaps ``removed`` and ``order``).

    Columns that sections don't have are left out; missing ones are null. Rows without an id can't be told apart and are left out.
    """
    own = [(F.col(f"`{f}`") if f in rows.columns else F.lit(None)).cast("string").alias(f) for f in _FIELDS]
    gone = (F.coalesce(F.col("removed"), F.lit(False)) if "removed" in rows.columns else F.lit(False)).alias("removed")
    return rows.filter("section_id is not null").select(*own, gone, (F.col(f"`{order}`") if order else F.lit(0)).alias("_order"))


def latest(rows: DataFrame) -> DataFrame:
    """One row of each section of ``plain`` rows: that of the largest ``_order``, of equal ones the largest in all columns."""
    row = F.struct("_order", *_FIELDS, "removed")
    return rows.select("section_id", row.alias("r")).groupBy("section_id").agg(F.max("r").alias("r")).select("r.*")


def write(spark: SparkSession, root: str, rows: DataFrame, order: str | None, s: Settings, count: chunking.TokenCounter) -> str:
    """The folder of a change that holds a batch.

    The batch is written as it comes. Ids and orders tell which rows count; only rows of equal order, and a few more, are shuffled
    with their texts. A batch without repeated or removed sections is its table of sections.
    """
    folder = f"change-{uuid.uuid4().hex[:12]}"
    path = f"{root}/{folder}"
    put = lambda df, name: df.write.options(**tables.PACKED).parquet(f"{path}/{name}")
    given = plain(rows, order)
    put(given, "rows")
    held = spark.read.schema(given.schema).parquet(f"{path}/rows")
    own = held.groupBy("section_id", "_order").agg(F.count("*").alias("n"), F.max("removed").alias("removed"))
    best = own.groupBy("section_id").agg(F.max("_order").alias("_best"), F.sum("n").alias("rows"), F.max("removed").alias("gone"))
    put(own.drop("removed").join(best, "section_id"), "keys")
    keys = spark.read.parquet(f"{path}/keys")
    put(keys.select("section_id").distinct(), "touched")
    most, gone = keys.agg(F.max("rows"), F.max("gone")).first()
    if most == 1 and not gone:
        tables.rename(spark, f"{path}/rows", f"{path}/sections")
    else:
        wins = F.col("_order").eqNullSafe(F.col("_best"))
        sure, met = tables.picked(held, ["section_id", "_order"], keys.filter(wins), keys.filter(~wins | (F.col("n") > 1)))
        put(sure.unionByName(latest(met)).filter("not removed").select(*_FIELDS), "sections")
        tables.delete(spark, f"{path}/rows")
    tables.delete(spark, f"{path}/keys")
    put(chunking.chunk(_part(spark, root, folder, "sections", 0).drop("_seq"), s, count), "chunks")
    return folder


def merged(spark: SparkSession, root: str, base: str | None, changes: list[str]) -> str:
    folder = f"corpus-{uuid.uuid4().hex[:12]}"
    for name in ("sections", "chunks"):
        read(spark, root, base, changes, name).write.options(**tables.PACKED).parquet(f"{root}/{folder}/{name}")
    return folder
