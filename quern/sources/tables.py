"""Readers and writers of the engine's tables, with declared schemas."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quern import schemas


def work_dir(spark: SparkSession) -> str:
    """The folder for written tables that driver and executors share: ``spark.checkpoint.dir``; a local one only where Spark is one process."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="quern-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rename(spark: SparkSession, name: str, goal: str) -> None:
    path, other = (spark._jvm.org.apache.hadoop.fs.Path(n) for n in (name, goal))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).rename(path, other):
        raise OSError(f"{name} could not be renamed to {goal}")


def saver(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a table to the shared folder and reads it again: what is used twice is made once, and lost executors don't matter."""

    def save(df: DataFrame) -> DataFrame:
        path = f"{work_dir(spark)}/held-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


#: How tables that stay on disk are written.
PACKED = {"compression": "zstd"}
#: 64-bit words of the bitmaps that ``picked`` broadcasts: their most rows, whatever the tables hold.
BITMAP_WORDS = 1 << 18


def picked(rows: DataFrame, names: list[str], keep: DataFrame, drop: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``names`` are in ``keep``: those that surely are, and those that a join had to look up.

    What ``rows`` have is in ``keep`` or in ``drop``; what is in both is looked up. Bitmaps of both are broadcast, so long rows are not
    shuffled, but for the share of the bitmaps that is set by chance. ``keep`` and ``drop`` are read more than once.
    """
    spot, bit = F.pmod(F.xxhash64(*names), F.lit(BITMAP_WORDS * 64)), "shiftleft(1L, cast(_spot & 63 as int))"
    sides = keep.select(spot.alias("_spot"), F.lit(True).alias("_in")).unionByName(drop.select(spot.alias("_spot"), F.lit(False).alias("_in")))
    bits = sides.groupBy(F.shiftright("_spot", 6).alias("_word")).agg(F.bit_or(F.expr(f"if(_in, {bit}, 0L)")).alias("_keep"), F.bit_or(F.expr(f"if(_in, 0L, {bit})")).alias("_drop"))
    met = rows.withColumn("_spot", spot).join(F.broadcast(bits), F.shiftright("_spot", 6) == F.col("_word"), "left")
    kept, dropped = (F.coalesce(F.expr(f"shiftright({c}, cast(_spot & 63 as int)) & 1L"), F.lit(0)) == 1 for c in ("_keep", "_drop"))
    own, same = keep.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(names)]), F.lit(True)
    for k, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"_{k}"))
    return met.filter(kept & ~dropped).select(rows.columns), met.filter(kept == dropped).select(rows.columns).join(own, same, "left_semi")


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sections(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.SECTION)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.CHUNK)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden items as JSON lines or, with the suffix yaml, as a YAML list (a small file, read on the driver)."""
    if not path.endswith((".yaml", ".yml")):
        return json_lines(spark, path, schemas.GOLDEN)
    import yaml

    raw = yaml.safe_load("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    items = raw["items"] if isinstance(raw, dict) else raw
    row = lambda x: (x["id"], x["question"], x.get("expected_sections", []), x.get("expected_subsections", []), x.get("source_type", "ecfr"), bool(x.get("adversarial", False)))
    return spark.createDataFrame([row(x) for x in items], schemas.GOLDEN)


def issue_date(spark: SparkSession, path: str, title: int) -> str:
    """``up_to_date_as_of`` of a title in a JSON file of titles."""
    rows = spark.read.schema("titles array<struct<number:int,up_to_date_as_of:string>>").json(path, multiLine=True)
    found = rows.select(F.explode("titles").alias("t")).filter(F.col("t.number") == title).select("t.up_to_date_as_of").take(1)
    if not found:
        raise ValueError(f"no title {title}")
    return found[0][0]


def xml_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that begin as PDFs do."""
    return spark.read.format("binaryFile").load(path).filter(F.substring("content", 1, 4) == F.lit(b"%PDF"))


def publications(spark: SparkSession, path: str) -> DataFrame:
    """The publications' manifest ``slug, title, url, kind``: a YAML file with the list ``documents`` (a small file, read on the driver)."""
    import yaml

    raw = yaml.safe_load("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) or {}
    return spark.createDataFrame([tuple(x.get(c) for c in ("slug", "title", "url", "kind")) for x in raw.get("documents") or []], schemas.PUBLICATION)


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON object; empty if it is missing or no JSON. Any other trouble of the store is an error."""
    try:
        rows = spark.read.text(path, wholetext=True).take(1)
        found = json.loads(rows[0][0]) if rows else {}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    except json.JSONDecodeError:
        return {}
    return found if isinstance(found, dict) else {}


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One small JSON file, replaced as a whole."""
    spark.createDataFrame([(json.dumps(value, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def version(manifest: dict) -> str:
    return manifest.get("corpus_version", "unknown")


def file_hashes(files: DataFrame) -> DataFrame:
    """``path, sha256`` of ``files (path, content)``."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def ingest_stats(sections_: DataFrame, chunks_: DataFrame, count) -> DataFrame:
    """``part, sections, chunks, tokens``: by part; tokens are those of the chunks."""
    own = sections_.groupBy("part").agg(F.count("*").alias("sections"))
    cut = chunks_.groupBy("part").agg(F.count("*").alias("chunks"), F.sum(count(F.col("text"))).cast("long").alias("tokens"))
    return own.join(cut, "part", "left").select("part", "sections", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def write(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def corpus_manifest(sections_: DataFrame, date: str) -> DataFrame:
    """One row: version, counts. The version hashes sections in order of their ids, in two levels."""
    parts = sections_.select("section_id", F.sha1(F.concat("section_id", F.coalesce("text", F.lit("")))).alias("h"), F.substring(F.sha1("section_id"), 1, 3).alias("part"))
    inner = parts.groupBy("part").agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", "h"))), lambda x: x["h"]), "")).alias("h"), F.count("*").alias("n"))
    return inner.agg(F.concat(F.lit(f"{date}-"), F.substring(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "")), 1, 8)).alias("version"), F.sum("n").alias("n_sections"))


def content_hash():
    return F.sha1(F.concat("chunk_id", F.coalesce("text", F.lit(""))))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of ``new (chunk_id, text)`` whose content hash ``old (chunk_id, hash)`` does not hold: those to embed."""
    hashed = new.withColumn("hash", content_hash())
    return hashed.join(old.select("chunk_id", "hash"), ["chunk_id", "hash"], "left_anti")
