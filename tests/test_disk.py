"""Batches of a stream move ids and hashes, not texts, and what they write is written once."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.config import Settings
from quern.engine import Engine
from quern.functions import text as T
from quern.operators import chunking
from quern.sources import changes, segments, tables

BATCH = f"{schemas.SECTION}, n int, removed boolean"


def batch(spark, rows):
    return spark.createDataFrame([(i, "s", "p", "a", "h", t, "u", n, gone) for i, t, n, gone in rows], BATCH)


def shuffled(spark) -> int:
    """Bytes that the session's stages have sent to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def size(path) -> int:
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_batches_shuffle_no_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FEW", 0, raising=False)
    draw = random.Random(1)
    words = [f"{draw.getrandbits(40):x}" for _ in range(500)]
    made = lambda: " ".join(draw.choices(words, k=600))
    first = [(f"s{n}", made(), 1, False) for n in range(600)]
    # half have an earlier text in the same batch
    second = [(f"s{n}", made(), k, False) for n in range(600) for k in ((2, 3) if n % 2 else (2,))]
    for n, rows in enumerate((first, second)):
        batch(spark, rows).write.parquet(f"{tmp_path}/in/{n}")
    engine, before = Engine(spark, str(tmp_path)), shuffled(spark)
    for n in range(2):
        engine.apply(spark.read.parquet(f"{tmp_path}/in/{n}"), "s", n, "n")
    assert shuffled(spark) - before < 0.5 * size(tmp_path / "in")
    held = engine._state()["segments"]
    assert {p.name for s in held for p in (tmp_path / s["name"]).iterdir()} == {"documents", "dead", "terms", "totals"}
    assert segments.tables(spark, str(tmp_path), held)["postings"].count() > 600 * 300


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_picked_is_exact_however_full_the_bitmaps_are(spark, monkeypatch, words):
    monkeypatch.setattr(tables, "BITMAP_WORDS", words)
    rows = spark.range(900).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("n"), F.lit("text").alias("t"))
    keep, drop = rows.filter("id % 4 <> 1").select("id", "n"), rows.filter("id % 4 = 1 or id % 100 = 0").select("id", "n")
    sure, met = tables.picked(rows, ["id", "n"], keep, drop)
    assert sorted(r.id for r in sure.unionByName(met).collect()) == [n for n in range(900) if n % 4 != 1]
    assert (met.count() < 30) == (words > 1) and {r.id for r in met.collect()} >= {n for n in range(0, 900, 100)}


@pytest.mark.parametrize("words", [1, 1 << 18])
@pytest.mark.parametrize("order", ["n", "x", None])
def test_the_last_row_of_a_section_counts(spark, tmp_path, monkeypatch, words, order):
    monkeypatch.setattr(tables, "BITMAP_WORDS", words)
    draw, nan = random.Random(words), float("nan")
    rows = [(f"s{draw.randint(0, 60)}", draw.choice(["a", "b", None]), draw.choice([1, 2, None]), draw.choice([0.0, -0.0, 1.0, nan, None]), draw.random() < 0.2) for _ in range(150)]
    given = spark.createDataFrame(rows, "section_id string, text string, n int, x double, removed boolean")
    folder = changes.write(spark, str(tmp_path), given, order, Settings(), T.count_tokens)
    got = {r.section_id: r.text for r in changes.read(spark, str(tmp_path), None, [folder], "sections").collect()}
    low = lambda v: (v is not None, v != v, 0 if v is None or v != v else v)  # nulls least, NaN largest
    key = lambda r: ((low({"n": r[2], "x": r[3]}[order]) if order else 0), (r[1] is not None, r[1] or ""), r[4])
    best = {}
    for r in rows:
        if r[0] not in best or key(r) > key(best[r[0]]):
            best[r[0]] = r
    assert got == {i: r[1] for i, r in best.items() if not r[4]}
    assert sorted(p.name for p in (tmp_path / folder).iterdir()) == ["chunks", "sections", "touched"]
    assert {r.section_id for r in spark.read.parquet(f"{tmp_path}/{folder}/touched").collect()} == set(best)


def test_many_batches_with_full_bitmaps_equal_a_fresh_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BITMAP_WORDS", 1)
    engine, draw, want = Engine(spark, str(tmp_path)), random.Random(5), {}
    for n in range(3):
        rows = {f"s{draw.randint(0, 30)}": (f"word{draw.randint(0, 9)} pump valve", draw.random() < 0.3) for _ in range(25)}
        engine.apply(batch(spark, [(i, t, 1, gone) for i, (t, gone) in rows.items()]), "s", n, "n")
        want = {i: t for i, t in (want | {i: None if gone else t for i, (t, gone) in rows.items()}).items() if t}
    assert {r.section_id: r.text for r in engine._read("sections").collect()} == want
    index = segments.tables(spark, str(tmp_path), engine._state()["segments"])
    made = chunking.chunk(engine._read("sections"))
    assert sorted(r.id for r in index["documents"].collect()) == sorted(r.chunk_id for r in made.collect())
    words = made.select(F.explode(F.array_distinct(T.content_words(F.col("text")))).alias("term")).groupBy("term").count()
    assert sorted(map(tuple, index["terms"].collect())) == sorted(map(tuple, words.collect()))
    live = segments.living(index["postings"], index["dead"])
    assert live.groupBy("term").count().exceptAll(words).count() == 0 and live.count() == words.agg(F.sum("count")).first()[0]
