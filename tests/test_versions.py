"""An index in segments answers as a fresh one does, and a search sees one whole version."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.engine import Engine
from quern.operators import retrieval
from quern.sources import segments
from quern.sources.snapshots import Conflict, Snapshots

WORDS = "pump valve house rule gate fan belt wheel motor glove acid heat mask boot rope ladder".split()


def chunks(spark, numbers, change=()):
    text = lambda i: " ".join(WORDS[(i * k + k) % len(WORDS)] for k in range(1, 8 + i % 5)) + f" unit{i}" + (" changed pump" if i in change else "")
    return spark.createDataFrame([(f"c{i}", text(i)) for i in numbers], "chunk_id string, text string")


def embed(text):
    return F.array(F.length(text).cast("double"), F.crc32(text.cast("binary")).cast("double"))


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def found(spark, index, asked):
    return sorted(map(tuple, retrieval.bm25_search(index, asked, 20).collect()))


def test_refresh_equals_a_fresh_index_and_writes_what_changed(spark, tmp_path):
    asked = spark.createDataFrame([(1, "pump valve"), (2, "unit7 acid"), (3, "changed"), (4, "unit1500 unit13")], "qid int, text string")
    held, report = segments.refresh(spark, str(tmp_path), [], chunks(spark, range(1500)), embed)
    assert report == {"added": 1500, "removed": 0, "segments": 1}
    whole = size(tmp_path)
    # one in a hundred: five changed, five gone, five new
    now = chunks(spark, [i for i in range(1505) if i not in (10, 11, 12, 13, 14)], change=(20, 21, 22, 23, 24))
    more, report = segments.refresh(spark, str(tmp_path), held, now, embed)
    assert report == {"added": 10, "removed": 10, "segments": 2}
    assert size(tmp_path) - whole < 0.1 * whole
    index = segments.tables(spark, str(tmp_path), more)
    fresh = retrieval.bm25_index(now, "chunk_id", "text")
    want = found(spark, fresh, asked)
    assert found(spark, index, asked) == want and len(want) > 40
    row = lambda df: sorted(map(tuple, df.collect()))
    assert row(index["terms"]) == row(fresh["terms"]) and row(index["stats"]) == row(fresh["stats"])
    assert row(index["vectors"].select("id", F.col("vector").cast("string"))) == row(now.select("chunk_id", embed(F.col("text")).cast("string")))
    # nothing new, nothing written
    before = size(tmp_path)
    assert segments.refresh(spark, str(tmp_path), more, now, embed)[0] == more and size(tmp_path) == before
    one = segments.compacted(spark, str(tmp_path), more)
    assert len(one) == 1 and found(spark, segments.tables(spark, str(tmp_path), one), asked) == want
    # a chunk that comes back lives again, and many dead rows compact by themselves
    back, report = segments.refresh(spark, str(tmp_path), more, chunks(spark, range(0, 1500, 3)), embed)
    assert len(back) == 1 and report["removed"] > 900
    assert found(spark, segments.tables(spark, str(tmp_path), back), asked) == found(spark, retrieval.bm25_index(chunks(spark, range(0, 1500, 3)), "chunk_id", "text"), asked)


def test_index_of_nothing(spark, tmp_path):
    asked = spark.createDataFrame([(1, "pump")], "qid int, text string")
    held, report = segments.refresh(spark, str(tmp_path), [], chunks(spark, range(3)).limit(0), embed)
    assert held == [] and report["segments"] == 0
    held, _ = segments.refresh(spark, str(tmp_path), [], spark.createDataFrame([("a", None), ("b", "")], "chunk_id string, text string"), embed)
    assert found(spark, segments.tables(spark, str(tmp_path), held), asked) == []
    held, _ = segments.refresh(spark, str(tmp_path), held, chunks(spark, range(3)).limit(0), embed)
    assert segments.tables(spark, str(tmp_path), held)["stats"].first()["n"] == 0


def test_versions_follow_each_other(spark, tmp_path):
    versions = Snapshots(spark, str(tmp_path))
    assert versions.current() == {"version": 0, "folders": []}
    for n, name in enumerate(("a", "b", "c")):
        (tmp_path / name).mkdir()
        assert versions.publish({"folders": [name, "a"] if name == "b" else [name]}, n) == n + 1
    with pytest.raises(Conflict):
        versions.publish({"folders": []}, 2)
    assert versions.current() == {"version": 3, "folders": ["c"]} and versions.collect(keep=2) == [] and versions.numbers() == [2, 3]
    assert versions.collect(keep=1) == ["a", "b"] and sorted(p.name for p in tmp_path.iterdir()) == ["_versions", "c"]


def sections(spark, word):
    text = f"(a) The {word} must be kept in the house for many years. (b) Every {word} is checked once a week by someone who knows."
    return spark.createDataFrame([(f"29 CFR 1910.{k}", "ecfr", "1910", "29 CFR 1910", f"Rule {k}", f"{text} number{k}", "u") for k in range(5)], schemas.SECTION)


def test_a_search_held_open_and_a_refresh_that_dies(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path))
    engine.refresh(sections(spark, "pump"), date="2026-01-01")
    asked = spark.createDataFrame([(1, "pump house number3")], "qid long, text string")
    old = engine.search(asked, 3)
    held = engine.pinned()
    # killed half-way: what is new is written, but no version names it
    with monkeypatch.context() as m:
        m.setattr(segments, "refresh", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            engine.refresh(sections(spark, "valve"), date="2026-01-02")
    assert all("pump" in r.chunk and "pump" in r.parent_text for r in engine.search(asked, 3).collect())
    engine.refresh(sections(spark, "valve"), date="2026-01-02")
    assert all("pump" in r.chunk and "pump" in r.parent_text for r in old.collect()) and all("pump" in r.chunk for r in held.search(asked, 3).collect())
    now = engine.search(asked, 3).collect()
    assert len(now) == 3 and all("valve" in r.chunk and "valve" in r.parent_text for r in now)
    state = json.loads(sorted((tmp_path / "_versions").glob("*.json"))[-1].read_text())
    assert set(state["folders"]) <= {p.name for p in tmp_path.iterdir()} and len(state["segments"]) == 1
