"""Pairs of items and documents that hold their text, of whatever length, as the SQL has them."""

import random
import string

import duckdb
import pytest

import __spark_entry__
from quern.plans import retrieval as plans

SHORT = ["pump", "pump valve", "al", "x", "é", "", " ", "\n", " pump", "valve\nhouse", "  ", "ump val", "absent", "two absent", "𝄞x", "𝄞", "a.b", ".*", None]
LONG = ["the pump valve house", "pump valve house", "valve  house", "ump valve hou", "pump\tvalve\nrule gate"]


def tables(spark, folder, items, docs):
    draw = random.Random(3)
    for name, rows, kind in (
        ("benchmark", items, "item_id long, text string"),
        ("documents", docs, "doc_id long, text string"),
        ("embeddings", [(n, 0, [draw.random() for _ in range(4)]) for n in range(len(docs))], "vec_id long, label int, embedding array<float>"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")


def sql(folder, text):
    con = duckdb.connect()
    for name in ("benchmark", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return sorted(con.execute(text).fetchall(), key=str)


DOCS = ["the pump valve house is old", "pumps", "a pump\tvalve\nrule gate", "", None, "xé y", "valve\nhouse pump valve  house", "clef 𝄞x a.b", "trump value", "no  such\nthing", "an al"]


def test_items_of_few_words_have_their_documents(spark, tmp_path):
    tables(spark, tmp_path, list(enumerate(SHORT + LONG)) + [(1, "pump valve house")], list(enumerate(DOCS)))
    want = sql(tmp_path, f"WITH {plans._RELEVANT} SELECT * FROM re")
    assert sorted(map(tuple, plans._relevant(spark, str(tmp_path)).collect()), key=str) == want
    assert {q for q, _ in want} >= {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 15, 16}


@pytest.mark.parametrize("seed", range(2))
def test_random_items(spark, tmp_path, seed):
    draw = random.Random(seed)
    made = lambda n: "".join(draw.choice("ab \n" + string.ascii_lowercase[:3]) for _ in range(n))
    tables(spark, tmp_path, [(n, made(draw.randint(0, 6))) for n in range(80)], [(n, made(draw.randint(0, 40))) for n in range(60)])
    assert sorted(map(tuple, plans._relevant(spark, str(tmp_path)).collect()), key=str) == sql(tmp_path, f"WITH {plans._RELEVANT} SELECT * FROM re")


@pytest.mark.parametrize("name", ["ab_eval", "ranking_metrics"])
def test_metrics_count_items_of_few_words(spark, tmp_path, name):
    items = [(n, t) for n, t in enumerate(["pump", "pump valve", "the pump valve house", "trump value", "no such"])]
    tables(spark, tmp_path, items, list(enumerate(DOCS)))
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = sql(tmp_path, f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
