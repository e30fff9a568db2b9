"""Streams into corpus, index and traces: batches that come again, die half-way or meet other writers leave each row once."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.engine import Engine
from quern.operators import chunking, retrieval
from quern.sources import changes, segments
from quern.sources.snapshots import Conflict
from quern.streaming.ingest import DailyTraces, sections_into

BATCH = f"{schemas.SECTION}, n int, removed boolean"


def rows(spark, *given):
    """Rows (id, text, n, removed)."""
    return spark.createDataFrame([(i, "s", "p", "a › b", f"Heading {i}", t, "u", n, gone) for i, t, n, gone in given], BATCH)


def held(engine):
    """Texts by section, after a look at chunks and index."""
    sections = {r.section_id: r.text for r in engine._read("sections").collect()}
    whole = chunking.chunk(engine._read("sections"))
    row = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert row(engine._read("chunks").select("chunk_id", "text")) == row(whole.select("chunk_id", "text"))
    index = segments.tables(engine.spark, engine.root, engine._state()["segments"])
    assert row(index["documents"].select("id")) == row(whole.select("chunk_id"))
    fresh = retrieval.bm25_index(whole, "chunk_id", "text")
    assert row(index["terms"]) == row(fresh["terms"]) and row(index["stats"]) == row(fresh["stats"])
    return sections


def test_batches_insert_change_and_remove(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path))
    first = rows(spark, ("a", "Pumps move water.", 1, False), ("b", "Belts wear out. " * 200, 1, False), ("c", None, 1, None), (None, "no id", 1, False), ("d", "old", 1, False), ("d", "new", 2, False), ("e", "tie", 1, False), ("e", "tie", 1, False))
    assert engine.apply(first, "s", 0, "n")["applied"]
    assert held(engine) == {"a": "Pumps move water.", "b": "Belts wear out. " * 200, "c": None, "d": "new", "e": "tie"}
    before = engine.pinned()
    # fewer chunks than before, a removal, a removal of nothing; what is the same is not embedded
    done = engine.apply(rows(spark, ("a", "Pumps move water.", 1, False), ("b", "Belts hold.", 1, False), ("c", None, 1, True), ("zz", None, 1, True)), "s", 1, "n")
    assert done["embedded"] == 1 and done["removed"] > 2
    assert held(engine) == {"a": "Pumps move water.", "b": "Belts hold.", "d": "new", "e": "tie"}
    assert before._read("sections").filter("section_id = 'c'").count() == 1  # who has opened a version goes on reading it
    # a batch that comes again changes nothing, whatever it holds
    version = engine._versions.current()["version"]
    assert not engine.apply(rows(spark, ("a", "other", 9, False)), "s", 1, "n")["applied"] and engine._versions.current()["version"] == version
    # another stream has numbers of its own; an empty batch is one
    assert engine.apply(rows(spark).limit(0), "t", 0)["applied"] and held(engine)["a"] == "Pumps move water."
    # removed ones come back, and many changes become one base
    monkeypatch.setattr(changes, "MOST", 3)
    engine.apply(rows(spark, ("c", "Fans cool.", 1, False)), "s", 2, "n")
    assert engine._state()["changes"] == [] and held(engine)["c"] == "Fans cool."
    engine.apply(rows(spark, ("c", "Fans blow.", 1, False)), "s", 3, "n")
    assert held(engine)["c"] == "Fans blow." and len(engine._state()["changes"]) == 1
    asked = spark.createDataFrame([(1, "what do fans blow")], "qid int, text string")
    assert engine.search(asked).filter("rank = 1").first().section == "c"
    # a whole ingest stands above all changes
    engine.refresh(rows(spark, ("x", "Ropes and ladders.", 1, False)).drop("n", "removed"))
    assert held(engine) == {"x": "Ropes and ladders."}


def test_other_columns_and_missing_ones(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    odd = spark.createDataFrame([("a", "text", 1, "extra", "last")], "section_id string, text string, id int, `chunk_id` string, `_last` string")
    engine.apply(odd, "s", 0)
    assert held(engine) == {"a": "text"} and engine._read("sections").columns == [f.split()[0] for f in schemas.SECTION.split(", ")]


def test_a_stream_that_dies_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    engine, real = Engine(spark, f"{tmp_path}/store"), Engine._publish
    stream = lambda: spark.readStream.schema(BATCH).parquet(f"{tmp_path}/in")
    put = lambda *given: rows(spark, *given).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: sections_into(engine, stream(), "s", f"{tmp_path}/at", "n").awaitTermination()
    put(("a", "one", 1, False))
    run()
    put(("a", "two", 2, False), ("b", "more", 1, False))

    def before(self, state):
        raise RuntimeError("killed before the version")

    monkeypatch.setattr(Engine, "_publish", before)
    with pytest.raises(Exception, match="killed"):
        run()
    assert {r.section_id: r.text for r in engine._read("sections").collect()} == {"a": "one"}

    def after(self, state):
        real(self, state)
        raise RuntimeError("killed after the version")

    monkeypatch.setattr(Engine, "_publish", after)
    with pytest.raises(Exception, match="killed"):
        run()
    assert held(engine) == {"a": "two", "b": "more"}
    version = engine._versions.current()["version"]
    monkeypatch.setattr(Engine, "_publish", real)
    run()
    assert engine._versions.current()["version"] == version and held(engine) == {"a": "two", "b": "more"}
    # another writer in between: the batch is done anew on top of it
    tries = []

    def beaten(self, state):
        tries.append(1)
        if len(tries) == 1:
            raise Conflict("taken")
        real(self, state)

    monkeypatch.setattr(Engine, "_publish", beaten)
    put(("b", None, 1, True))
    run()
    assert len(tries) == 2 and held(engine) == {"a": "two"}


TRACE = "query_id string, ts timestamp, note string"


def traced(spark, *given):
    return spark.createDataFrame([(k, ts and datetime.fromisoformat(ts), note) for k, ts, note in given], TRACE)


def notes(table):
    rows = table.read().collect()
    assert len({r.query_id for r in rows}) == len(rows)
    return {r.query_id: r.note for r in rows}


def test_traces_by_day(spark, tmp_path, monkeypatch):
    table = DailyTraces(spark, str(tmp_path), TRACE)
    assert notes(table) == {} and table.merge(traced(spark).limit(0), "s", 0) and notes(table) == {}
    day = traced(spark, ("a", "2026-01-01 10:00:00", "a1"), ("b", "2026-01-02 23:59:59.999999", "b1"), ("c", "2026-01-03 00:00:00", "c1"), (None, "2026-01-01 10:00:00", "nobody"), ("n", None, "n1"), ("a", "2026-01-01 09:00:00", "a0"))
    assert table.merge(day, "s", 1) and notes(table) == {"a": "a1", "b": "b1", "c": "c1", "n": "n1"}
    old = table._versions.current()["days"]
    assert sorted(old) == ["2026-01-01", "2026-01-02", "2026-01-03", "none"]
    # a key moves to another day, one is older than what is there, one of the same time stands above
    later = traced(spark, ("a", "2026-01-03 08:00:00", "a2"), ("c", "2026-01-01 08:00:00", "c0"), ("n", "2026-01-03 01:00:00", "n2"))
    assert table.merge(later, "s", 2) and notes(table) == {"a": "a2", "b": "b1", "c": "c1", "n": "n2"}
    new = table._versions.current()["days"]
    assert sorted(new) == ["2026-01-02", "2026-01-03"] and new["2026-01-02"] == old["2026-01-02"]  # days without a change stay as written
    assert table.merge(traced(spark, ("c", "2026-01-03 00:00:00", "c2")), "s", 3) and notes(table)["c"] == "c2"
    assert not table.merge(later, "s", 2) and notes(table)["c"] == "c2"
    # a merge that dies before its version leaves what was
    monkeypatch.setattr(table._versions, "publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.merge(traced(spark, ("b", "2026-02-01 00:00:00", "b2")), "s", 4)
    monkeypatch.undo()
    assert notes(table)["b"] == "b1"
    assert table.merge(traced(spark, ("b", "2026-02-01 00:00:00", "b2")), "s", 4) and notes(table) == {"a": "a2", "b": "b2", "c": "c2", "n": "n2"}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert table.merge(table.read().filter("query_id = 'b'").withColumn("note", F.lit("b3")), "s", 5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert notes(table)["b"] == "b3" and sorted(table._versions.current()["days"]) == ["2026-01-03", "2026-02-01"]
