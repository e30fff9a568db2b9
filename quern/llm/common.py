"""Helpers shared by the training-data operators: scratch tables, picking rows by key, Arrow text."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (tests, a laptop) a local
    folder is set; on a cluster its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="quern-")
    spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Written tables of one run, in the shared folder; each can be dropped, or all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again: its lineage ends here, lost executors don't matter."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``save`` wrote and nothing needs any more."""
        for df in tables:
            self._delete(df._quern_path)

    def only(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as ``save`` does, then delete all other tables of the run."""
        earlier = range(1, self._n + 1)
        out = self.save(df)
        for n in earlier:
            self._delete(f"{self.root}/{n}")
        return out

    def clear(self) -> None:
        """Delete all tables of the run."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: 64-bit words of the bitmap that ``apart`` broadcasts: its most rows, whatever the tables hold.
FILTER_WORDS = 1 << 18


def apart(rows: DataFrame, key: str, side: DataFrame, side_key: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key may be in ``side``, and those whose key is surely not (null keys too).

    A bitmap of the hashed keys of ``side`` is broadcast; it has at most FILTER_WORDS
    rows of two numbers. So a join with a few rows of a large table shuffles these few
    (and the share of the bitmap that is set), and the others stay where they are.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS * 64))
    keys = side.select(spot(side_key).alias("spot")).select(F.shiftright("spot", 6).alias("_word"), F.col("spot").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = scratch.save(keys.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("_bits")))
    own = rows.withColumn("_spot", spot(key))
    met = own.join(F.broadcast(words), F.shiftright("_spot", 6) == F.col("_word"), "left")
    maybe = F.col(key).isNotNull() & F.coalesce(F.expr("shiftright(_bits, cast(_spot & 63 as int)) & 1L"), F.lit(0)).eqNullSafe(F.lit(1))
    return met.filter(maybe).select(rows.columns), met.filter(~maybe).select(rows.columns)


def in_slices(batches, rows: int = 1000):
    """The batches in parts of at most ``rows`` rows; Arrow's spare memory is given back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and their n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


#: SplitMix64's constants (fixed values).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def random_u64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, np.uint64)
