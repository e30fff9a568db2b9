"""Streams into the engine's tables: sections into corpus and index, traces into tables by day.

Both take micro-batches through ``foreachBatch``. A batch is published by one small file, which also names the
batch's number, so a query that is killed and started again neither loses a batch nor applies one twice. A stream's
``name`` belongs to its checkpoint: who begins with a new checkpoint takes a new name, since numbers begin at 0 again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.engine import Engine
from quern.sources.snapshots import Conflict, Snapshots
from quern.sources.tables import delete


def _started(stream: DataFrame, each, name: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = stream.writeStream.queryName(f"{name}-{uuid.uuid4().hex[:6]}").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()


def sections_into(engine: Engine, stream: DataFrame, name: str, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """A stream of sections (``quern.sources.changes.plain``) into the engine's corpus and index; by default what is there now, then it ends."""
    return _started(stream, lambda rows, batch: engine.apply(rows, name, batch, order), name, checkpoint, trigger)


class DailyTraces:
    """Traces by day under ``root``, one row a key; a merge writes the days it changes and no others.

    ``schema`` has ``key`` and ``ts`` (timestamp). Of rows with the same key the latest ``ts`` counts, then the larger in ``order``,
    then the one that came later, then the larger hash of all columns. Rows without a key are left out; those without
    a time are in a day of their own and older than all. The version is a map of days, as many entries as days.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "query_id", ts: str = "ts", order: tuple[str, ...] = ()):
        self.spark, self.root, self.schema, self.key, self.ts, self.order = spark, root, schema, key, ts, order
        self._versions = Snapshots(spark, root)

    def _day(self) -> Column:
        """The day in UTC, whatever the session's time zone is."""
        days = F.floor(F.unix_seconds(self.ts) / 86400).cast("int")
        return F.coalesce(F.date_from_unix_date(days).cast("string"), F.lit("none"))

    def _of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._of(sorted(self._versions.current().get("days", {}).values()))

    def merge(self, rows: DataFrame, stream: str, batch: int) -> bool:
        """Inserts or replaces a batch's rows; False if the batch was merged before."""
        for _ in range(5):
            state = self._versions.current()
            if batch <= state.get("streams", {}).get(stream, -1):
                return False
            try:
                self._merged(state, rows, stream, batch)
                return True
            except Conflict:
                continue
        raise Conflict(f"batch {batch} of {stream}: others publish all the time")

    def _newest(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c != "_came"]
        order = [F.desc_nulls_last(self.ts), *[F.desc_nulls_last(c) for c in self.order], F.desc("_came"), F.desc(F.xxhash64(*names))]
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(*order))).filter("_n = 1").drop("_n", "_came")

    def _merged(self, state: dict, rows: DataFrame, stream: str, batch: int) -> None:
        folder, days = f"days-{uuid.uuid4().hex[:12]}", dict(state.get("days", {}))
        names = self.spark.createDataFrame([], self.schema).columns
        new = self._newest(rows.filter(F.col(self.key).isNotNull()).select(*names).withColumn("_came", F.lit(1)))
        new.write.parquet(f"{self.root}/{folder}/batch")
        new = self._of([f"{folder}/batch"])
        # a key may have a row in another day
        held = self._of(sorted(days.values())).select(self.key, self.ts).join(new.select(self.key), self.key, "left_semi")
        touched = {r[0] for r in new.select(self._day()).unionByName(held.select(self._day())).distinct().collect()}  # days
        old = self._of([days[d] for d in sorted(touched & days.keys())])
        both = self._newest(old.withColumn("_came", F.lit(0)).unionByName(new.withColumn("_came", F.lit(1)))).withColumn("_day", self._day())
        both.repartition("_day", F.pmod(F.xxhash64(self.key), F.lit(8))).write.partitionBy("_day").parquet(f"{self.root}/{folder}/out")
        made = {r[0] for r in self.spark.read.schema(f"{self.schema}, _day string").parquet(f"{self.root}/{folder}/out").select("_day").distinct().collect()}
        days = {d: f for d, f in days.items() if d not in touched} | {d: f"{folder}/out/_day={d}" for d in made}
        streams = state.get("streams", {}) | {stream: batch}
        self._versions.publish({"days": days, "streams": streams, "folders": sorted(days.values())}, state["version"])
        delete(self.spark, f"{self.root}/{folder}/batch")
        self._versions.collect()

    def traces_into(self, stream: DataFrame, name: str, checkpoint: str, **trigger) -> StreamingQuery:
        return _started(stream, lambda rows, batch: self.merge(rows, name, batch), name, checkpoint, trigger)
