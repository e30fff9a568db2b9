import hashlib
import json
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern import models, obs, schemas
from quern.config import Settings
from quern.functions import citations as C
from quern.functions import text as T
from quern.operators import answers, chunking, cleaning, evaluation, retrieval, traces
from quern.sources import tables
from quern.plans import answers as answer_plans, corpus, registry  # noqa: F401
from quern.plans import retrieval as plans  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


def one(spark, value, column, name="text"):
    return spark.createDataFrame([(value,)], f"{name} string").select(column(F.col(name)).alias("x")).first()["x"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    return f"{float(x):.7g}" if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return [tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: [str(x) for x in r]
    assert sorted(rows(got), key=key) == sorted(rows(want), key=key)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(("value", "root"), [("29 CFR 1910.132(b)(1)", "29 CFR 1910.132"), ("§1910.134(d)(2)(ii)", "29 CFR 1910.134"), ("1910.1000", "29 CFR 1910.1000"), ("OSHA 3151 (pp. 4-6)", "OSHA 3151"), ("OSHA FS-INSPECTIONS (p. 1)", "OSHA FS-INSPECTIONS")])
def test_normal_form(spark, value, root):
    assert one(spark, value, C.normalise) == root


def test_parse(spark):
    refs = one(spark, "See 29 CFR 1910.132(b)(1), §1910.134(d)(2)(ii), OSHA 3151 (pp. 4-6), OSHA FS3529; an OSHA question; 29 CFR 1910.132(b)(1).", C.parse)
    assert [(r["root"], list(r["subsections"]), r["page_lo"], r["page_hi"]) for r in refs] == [("29 CFR 1910.132", ["b", "1"], None, None), ("29 CFR 1910.134", ["d", "2", "ii"], None, None), ("OSHA 3151", [], 4, 6), ("OSHA FS3529", [], None, None)]


def test_validation(spark):
    text = "(a) first (b) then (1) and (h) last"
    written = [(1, "29 CFR 1910.132(h)"), (2, "29 CFR 1910.132(z)"), (3, "29 CFR 1910.99"), (4, "OSHA 3151 (p. 6)"), (5, "OSHA 3151 (p. 30)"), (6, "29 CFR 1910.132(b)(1) and 29 CFR 1910.132(c)(1)")]
    context = [(k, "29 CFR 1910.132", text) for k in (1, 2, 3, 6)] + [(k, "OSHA 3151 (pp. 5-7)", "t") for k in (4, 5)]
    out = answers.validate(spark.createDataFrame(written, "aid long, answer string"), spark.createDataFrame(context, "aid long, section_id string, text string"))
    got = {}
    for r in out.orderBy("aid", "pos").collect():
        got.setdefault(r["aid"], []).append(r["valid"])
    assert got == {1: [True], 2: [False], 3: [False], 4: [True], 5: [False], 6: [True, False]}
    assert {r["aid"]: (r["n_valid"], r["n_hallucinated"]) for r in answers.summary(out).collect()}[6] == (1, 1)


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, "R1", 1), (1, "R2", 2), (2, "X", 1), (2, "Y", 2), (2, "R", 3), (3, "X", 1)], "qid long, id string, place int")
    relevant = spark.createDataFrame([(1, "R1"), (2, "R"), (3, "R")], "qid long, id string")
    got = {r["qid"]: r for r in evaluation.ranking_metrics(relevant.select("qid").distinct(), ranking, relevant).collect()}
    assert (got[1]["hit1"], got[1]["mrr"], got[1]["ndcg"]) == (1, 1, 1)
    assert (got[2]["hit1"], got[2]["hit3"], got[2]["mrr"]) == (0, 1, round(1 / 3, 6)) and 0 < got[2]["ndcg"] < 1
    assert (got[3]["hit10"], got[3]["mrr"], got[3]["ndcg"]) == (0, 0, 0)


def tokens(text):
    return len(re.findall(r"[^\W]+|[^\s\w]", text))


def packed(spark, bodies):
    """What ``pack`` makes of (body, budget)."""
    df = spark.createDataFrame([(i, b, n) for i, (b, n) in enumerate(bodies)], "i int, body string, budget int")
    return [tuple(r["p"]) for r in df.select("i", chunking.pack(F.col("body"), F.col("budget")).alias("p")).orderBy("i").collect()]


def test_pack_never_passes_the_budget_nor_cuts_a_sentence(spark):
    rng = np.random.default_rng(0)
    cases = [("One short paragraph.", 100)]
    for _ in range(40):
        cases.append(("\n".join("Word " + "a " * n + "end." for n in rng.integers(1, 12, rng.integers(1, 30))), int(rng.integers(5, 60))))
    out = packed(spark, cases)
    assert out[0] == ("One short paragraph.", False)
    for (body, budget), (text, cut) in zip(cases[1:], out[1:]):
        assert tokens(text.replace(" [...]", "")) <= budget + 1
        if not text.endswith("[...]"):
            assert all(line.endswith("end.") for line in text.split("\n") if line)
        assert cut or text == body
    lone = "Word " + "abc " * 99 + "end."
    assert packed(spark, [(lone, 10), ("", 5), ("First one. Second two. Third three.", 4)]) == [(lone[: len(lone) * 10 // 102] + " [...]", True), ("", False), ("First one.", True)]


def test_chunks_hold_all_sentences(spark):
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(30):
        texts.append([f"Item {k} " + "x " * n + "end." for k, n in enumerate(rng.integers(1, 30, rng.integers(1, 40)))])
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)] + [(99, "Long " + "word, " * 400 + "end. " + "Tail end.")], "i int, text string")
    out = {r["i"]: r["w"] for r in df.select("i", chunking.windows(F.col("text"), 40, 10, 8).alias("w")).collect()}
    for i, sentences in enumerate(texts):
        assert all(any(s in c for c in out[i]) for s in sentences)
        assert len(out[i]) == 1 or all(tokens(c) <= 40 + 40 for c in out[i])
        # a window begins with the last sentences of the one before
        assert all(any(b.startswith(s) for s in sentences if s in a) for a, b in zip(out[i], out[i][1:]))
    assert len(out[99]) > 10 and "word," in out[99][0]
    section = spark.createDataFrame([("S 1", "ecfr", "1", "p", "Head", None, "u")], schemas.SECTION)
    assert tuple(chunking.chunk(section).first()) == ("S 1#0", "S 1", 0, "Head", "S 1 — Head\n", "ecfr", "1", "p", "u")


def test_context_counts_a_section_once_and_keeps_the_budget(spark):
    body = "\n".join(f"Sentence number {k} ends here." for k in range(60))
    hits = [(1, p, sec, "h", "path", "src", body) for p, sec in enumerate(["A", "A", "B", "C"], 1)] + [(2, 1, "Z", "h", "path", "src", None)]
    out = {r["qid"]: r for r in chunking.assemble(spark.createDataFrame(hits, "qid int, place int, section string, heading string, path string, source string, body string"), 700).collect()}
    assert out[1]["included"] == ["A", "B"] and tokens(out[1]["context"]) <= 700 + 30 and out[1]["context"].count(chunking.OMITTED.strip()) == 1
    assert out[1]["texts"]["A"] == body and body.startswith(out[1]["texts"]["B"]) and out[2]["included"] == ["Z"]


def test_mmr_has_no_duplicates_and_keeps_the_cap(spark):
    rng = np.random.default_rng(0)
    pool = [(1, i, i + 1, f"s{i % 3}", 1 - i / 20, rng.normal(size=4).tolist()) for i in range(20)]
    got = [r["id"] for r in retrieval.mmr(spark.createDataFrame(pool, "qid long, id long, pos int, section string, relevance double, vector array<double>")).orderBy("place").collect()]
    assert len(got) == len(set(got)) == 6 and got[0] == 0
    assert max(sum(i % 3 == s for i in got) for s in range(3)) <= 2


def test_rrf_prefers_what_both_legs_found(spark):
    legs = [spark.createDataFrame([(1, i, 1.0, r) for r, i in enumerate(ids, 1)], f"qid long, id long, {n}_score double, {n}_rank int") for n, ids in (("dense", [7, 8]), ("sparse", [8, 9]))]
    assert retrieval.in_order(retrieval.fuse(*legs).withColumn("exact", F.lit(False))).orderBy("pos").first()["id"] == 8


def test_dense_in_blocks_equals_brute_force(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.when(F.col("vec_id") % 50 != 7, F.col("embedding")).alias("embedding"))
    asked = vectors.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    got = {}
    for r in retrieval.dense_topk(vectors, asked, 5, block=16, block_rows=40).collect():
        got.setdefault(r["qid"], []).append((r["dense_rank"], r["id"]))
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in vectors.collect() if r["embedding"] is not None]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i, v in zip(ids, x):
        if i % 5 == 0:
            assert [k for _, k in sorted(got[i])] == ids[np.lexsort((ids, -np.round(x @ v, 10)))[:5]].tolist()
    assert retrieval.dense_topk(vectors, asked.limit(0), 5).count() == 0 == retrieval.dense_topk(vectors.limit(0), asked, 5).count()


def test_bm25_tables_give_what_a_fresh_index_gives(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the pump house and the pump"), (2, None), (3, "pump"), (4, "valves only")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "Pump pump!"), (2, "the"), (3, "valves pump")], "qid int, text string")
    retrieval.write_bm25(docs, str(tmp_path))
    one, other = (sorted(map(tuple, df.collect())) for df in (retrieval.bm25_topk(docs, asked), retrieval.bm25_search(retrieval.load_bm25(spark, str(tmp_path)), asked)))
    assert one == other and [r[:2] for r in one] == [(1, 1), (1, 3), (3, 1), (3, 3), (3, 4)]
    n, dl, avg = 4, 3, 6 / 4
    want = np.log(1 + (n - 2 + 0.5) / 2.5) * 2 / (2 + 1.5 * (0.25 + 0.75 * dl / avg))
    assert abs(one[0][2] - want) < 1e-6 and retrieval.load_bm25(spark, str(tmp_path))["stats"].first()["n"] == 4


def test_leg_of_no_hits_is_empty(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    assert retrieval.dense_topk(v, q, 0).count() == 0 and retrieval.dense_topk(v.limit(0), q, 3).count() == 0


def test_guard(spark):
    ev = spark.createDataFrame([(0.9, 0.9, False, None), (0.9, 0.01, False, None), (0.1, 0.2, False, None), (0.9, 0.9, False, -1.0)], "max_cos double, overlap double, exact boolean, rerank_best double")
    assert [r["reason"] for r in retrieval.guard(ev).collect()] == [None, "out_of_domain", "low_grounding", "weak_evidence"]


LONG = "Each employer shall keep a written record of the exposure of every employee to the substances in this table, for thirty years."
XML = f"""<ROOT><DIV5 N="1910" TYPE="PART"><HEAD>P</HEAD><DIV6 N="A" TYPE="SUBPART"><HEAD>Subpart A—General</HEAD>
<DIV8 N="1910.1000" TYPE="SECTION"><HEAD>§ 1910.1000 Air.</HEAD><P>One <I>two</I> three. {LONG}</P><GPOTABLE><TR><TH>a</TH><TD/><TD>b</TD></TR></GPOTABLE><CITA>no</CITA><FPNOTE>no</FPNOTE>
<DIV9 N="A" TYPE="APPENDIX"><HEAD>App A</HEAD><P>More. {LONG}</P></DIV9></DIV8>
<DIV8 N="1910.7" TYPE="SECTION"><HEAD>§ 1910.7 [Reserved]</HEAD><P>{LONG}</P></DIV8><DIV8 N="1910.8" TYPE="SECTION"><HEAD>§ 1910.8 Short.</HEAD><P>Too short.</P></DIV8></DIV6>
<DIV6 N="B" TYPE="SUBPART"><HEAD>Subpart B—More</HEAD><DIV7 TYPE="SUBJGRP"><HEAD>Group</HEAD><DIV8 N="1910.9" TYPE="SECTION"><HEAD>§ 1910.9 Water.</HEAD><P>{LONG}</P></DIV8></DIV7>
<DIV9 N="A" TYPE="APPENDIX"><HEAD>App A</HEAD><P>{LONG}</P></DIV9><DIV9 N="A" TYPE="APPENDIX"><HEAD>App A</HEAD><P>{LONG}</P></DIV9></DIV6></DIV5>
<DIV5 N="40" TYPE="PART"><DIV8 N="40.1" TYPE="SECTION"><HEAD>X</HEAD><P>{LONG}</P></DIV8></DIV5></ROOT>""".encode()


def test_xml_sections(spark):
    got = {r["section_id"]: r for r in cleaning.parse_xml(spark.createDataFrame([("a.xml", bytearray(XML)), ("b.xml", bytearray(b"<ROOT/>"))], "path string, content binary")).collect()}
    assert set(got) == {"29 CFR 1910.1000", "29 CFR 1910 App A", "29 CFR 1910.9", "29 CFR 1910 Subpart B App A", "29 CFR 1910 Subpart B App A (29 CFR 1910 › Subpart B—More)"}
    air, water = got["29 CFR 1910.1000"], got["29 CFR 1910.9"]
    assert air["text"] == f"One two three. {LONG}\na | b" and air["heading"] == "Air." and air["part"] == "1910" and air["url"].endswith("title-29/section-1910.1000")
    assert water["parent_path"] == "29 CFR 1910 › Subpart B—More › Group" and got["29 CFR 1910 App A"]["text"] == f"More. {LONG}"


def test_html_blocks(spark):
    html = "<html><head><title>t</title></head><body><nav>menu</nav><h1>Top</h1><p>a <b>b</b><br>c</p><script>x()</script><table><tr><th>k</th><td></td><td>v</td></tr></table><ul><li>one</li><li> </li></ul>tail</body></html>"
    got = cleaning.html_blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, h string"), "id", "h").orderBy("id", "block").collect()
    assert [tuple(r) for r in got] == [(1, 0, "Top"), (1, 1, "a b c"), (1, 2, "k | v"), (1, 3, "one"), (1, 4, "tail")]


def test_citation_display(spark):
    assert one(spark, "see [29 CFR 1910.132(b)] and 【OSHA 3146 (pp. 7-9)】, [x]", C.linked) == "see [29 CFR 1910.132(b)](#cite:29%20CFR%201910.132(b)) and [OSHA 3146 (pp. 7-9)](#cite:OSHA%203146%20(pp.%207-9)), [x]"
    assert one(spark, "none", C.linked) == "none" and one(spark, None, C.linked) is None
    bad = F.array(F.lit("29  cfr 1910.1 "))
    assert one(spark, "29 CFR 1910.1", lambda c: C.is_invalid(c, bad)) and not one(spark, None, lambda c: C.is_invalid(c, bad))
    sources = F.array(*[F.struct(F.lit(x).alias("section_id")) for x in ("29 CFR 1910.1", "29 CFR 1910.2")])
    pick = lambda sel, opened: one(spark, sel, lambda c: C.source_for(sources, c, F.lit(opened).cast("string"))["section_id"])
    assert pick("29 CFR 1910.2(b)", None) == "29 CFR 1910.2" and pick(None, "29 CFR 1910.2") == "29 CFR 1910.2" and pick("29 CFR 1910.3", None) == "29 CFR 1910.1"


def test_answer_metrics(spark):
    row = spark.createDataFrame([(4, 3, 1, [1.0, 0.0], [1.0, 0.0], [0.0, 2.0]), (0, 0, 0, [1.0, 1.0], [1.0, 0.0], [0.0, 0.0])], "n_cited int, n_valid int, n_hallucinated int, answer_vec array<double>, context_vec array<double>, question_vec array<double>")
    got = [tuple(r)[6:] for r in evaluation.answer_metrics(row).collect()]
    assert got == [(0.75, 1.0, 1.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.7071, 0.0)]


def test_subsection_evidence(spark):
    items = spark.createDataFrame([(1, ["A"], ["b", "1"]), (2, ["A"], ["z"]), (3, ["A"], []), (4, ["C"], ["b"])], "qid int, expected array<string>, markers array<string>")
    ranking = spark.createDataFrame([(q, x, p) for q in (1, 2, 3, 4) for p, x in enumerate(["B", "A", "A", "B", "B", "C"], 1)], "qid int, id string, place int")
    sections = spark.createDataFrame([("A", "(b) x ( 1 )"), ("B", "(z)"), ("C", "(b)")], "section_id string, text string")
    assert {r[0]: r[1] for r in evaluation.subsection_evidence(items, ranking, sections).collect()} == {1: 1.0, 2: 0.0, 4: 0.0}


def test_expressions(spark):
    assert one(spark, "  a  b\n", T.collapse) == "a b"
    assert one(spark, "", T.sentences) == [] and one(spark, None, T.sentences) == []
    assert one(spark, "Hello there!", T.is_conversational) and not one(spark, "hello world of pipes", T.is_conversational)
    assert one(spark, "line\n12\nOSHA 3151\nwww.osha.gov\nmore", T.without_noise_lines) == "line more"


def test_history_is_cut_before_the_roles(spark):
    turns = spark.createDataFrame([(1, k, "system" if k == 5 else "user", f"t{k}") for k in range(6)], "c long, t int, role string, text string")
    assert [r["t"] for r in answers.history(turns, "c", "t", "role", "text").orderBy("t").collect()] == [2, 3, 4]


def test_percentile_by_index(spark):
    df = spark.createDataFrame([(float(k),) for k in [5, 1, 4, 2, 3, 3]], "v double")
    r = traces.at_index(df, "v", {"a": 0.5, "b": 0.95}).first()
    assert (r["a"], r["b"]) == (3.0, 5.0)


def test_percentile_beside_an_outlier_and_a_frequent_value(spark):
    values = [1e12, -5.0] + [7.0] * 500 + [k / 10 for k in range(1000)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = traces.at_index(rows, "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (got["p50"], got["p95"]) == tuple(round(sorted(values)[int(p * len(values))], 1) for p in (0.5, 0.95))


def test_ids_of_a_frequent_name_are_numbered_in_order(spark):
    rng = np.random.default_rng(3)
    names = ["hot" if k % 3 else f"n{k % 50}" for k in range(900)] + [None] * 5
    orders = [f"{k:04}" for k in rng.permutation(len(names))]
    frame = spark.createDataFrame(list(zip(names, orders)), "name string, at string")
    seen, want = {}, []
    for at, name in sorted(zip(orders, names)):
        n = seen[name] = seen.get(name, 0) + 1
        want.append((at, name and name + ("" if n == 1 else " again" if n == 2 else f" again#{n}")))
    got = cleaning.unique_ids(frame, "name", "at", F.lit("again"))
    assert got.columns == ["name", "at", "unique_id"] and sorted((r["at"], r["unique_id"]) for r in got.collect()) == want
    assert cleaning.unique_ids(frame.limit(0), "name", "at", F.lit("again")).count() == 0


def test_stream(spark, tmp_path):
    from quern.streaming.traces import windowed_stats

    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_stats(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == windowed_stats(batch).count()


def test_settings():
    assert Settings().override(final_top_k=3, rrf_k=None).final_top_k == 3 and Settings().override(rrf_k=None).rrf_k == 60


class Speaker:
    """An answerer that says what it is told to and keeps what it was asked."""

    def __init__(self, said):
        self.said, self.asked = said, None

    def stream(self, messages, max_tokens, temperature):
        self.asked = messages
        if self.said is None:
            raise RuntimeError("no model")
        yield from self.said


def test_engine(spark, tmp_path):
    from quern.engine import Engine

    rows = [(f"29 CFR 1910.{k}", "ecfr", "1910", "29 CFR 1910", f"Rule {k}", f"(a) Pump number{k} must be kept in house{k}. (b) Valve number{k} is checked (1) every week{k}.", f"u{k}") for k in range(100, 130)]
    more = spark.createDataFrame([("OSHA 3151 (pp. 1-3)", "osha_pdf", "OSHA-BOOKLET", "OSHA Publications", "Gloves", "Gloves protect hands from acid and heat.", "u")], schemas.SECTION)
    engine = Engine(spark, str(tmp_path), Settings(grounding_threshold=0.3))
    files = spark.createDataFrame([("a.xml", bytearray(b"x"))], "path string, content binary")
    assert engine.describe()["status"] == "empty" and engine.latest_report() == {}
    stats = engine.refresh(spark.createDataFrame(rows, schemas.SECTION), more, date="2026-01-02", files=files)
    assert stats["sections"] == stats["chunks"] == stats["embedded"] == 31 and stats["sections_by_part"] == {"1910": 30, "OSHA-BOOKLET": 1} and stats["tokens"] > 300
    manifest = tables.read_json(spark, f"{tmp_path}/manifest.json")
    assert manifest["corpus_version"].startswith("2026-01-02-") and manifest["sources"][0]["sha256"] == hashlib.sha256(b"x").hexdigest() and tables.version({}) == "unknown"
    assert engine.build_index() == 0 and engine.describe()["index"]["points"] == 31  # nothing new to embed
    asked = spark.createDataFrame([(1, "pump number105 house105"), (2, "what does 29 CFR 1910.117(b) say"), (3, "zebra quasar")], "qid long, text string")
    hits = engine.search(asked, 3).collect()
    best = {h["qid"]: h for h in hits if h["rank"] == 1}
    assert best[1]["section"] == "29 CFR 1910.105" and best[1]["url"] == "u105" and best[1]["chunk"].startswith("29 CFR 1910.105 — Rule 105") and best[1]["final_score"] == best[1]["rerank_score"]
    got = {r["qid"]: r for r in engine.retrieve(asked).collect()}
    assert not got[1]["refused"] and got[2]["exact"] and not got[2]["refused"] and got[3]["reason"] == "out_of_domain" and "29 CFR 1910.105" in got[1]["included"]
    past = [{"role": "user", "content": f"q{k}"} for k in range(6)] + [{"role": "system", "content": "x"}]
    speaker = Speaker(["See [29 CFR 1910.105(b)(1)]", " and [29 CFR 1910.999]."])
    engine.models = models.Models(answerer=speaker)
    said = list(engine.chat("pump number105 house105", past))
    assert [e["type"] for e in said] == ["meta", "sources", "token", "token", "done"] and said[0]["timings"][0]["stage"] == "retrieve"
    assert [m["role"] for m in speaker.asked] == ["system", "user", "user", "user", "user"] and "SOURCE_DATA" in speaker.asked[0]["content"]
    checked = said[-1]["citations"]
    assert checked["valid"] == ["29 CFR 1910.105"] and checked["hallucinated"] == ["29 CFR 1910.999"] and "warning" in said[-1]
    assert list(engine.chat("zebra quasar"))[-1]["reason"] == "out_of_domain" and list(engine.chat("x"))[0]["type"] == "error"
    engine.models = models.Models(answerer=Speaker(None))
    assert list(engine.chat("pump number105 house105"))[-1]["type"] == "error"
    engine.models = models.Models()
    assert list(engine.chat("hello"))[-1]["citations"]["n_cited"] == 0
    assert engine.trace_stats().first()["total_traces"] == 3 and {r[0] for r in engine.top_cited().collect()} == {"29 CFR 1910.105", "29 CFR 1910.999"}
    golden = spark.createDataFrame([("g1", "pump number105 house105", ["29 CFR 1910.105"], ["b", "1"], "ecfr", False), ("g2", "gloves acid heat", ["OSHA 3151"], [], "osha_pdf", False), ("a1", "zebra quasar", [], [], "ecfr", True)], schemas.GOLDEN)
    run = engine.evaluate(golden, {"hybrid_rerank": {"rerank": True}}, with_answers=True).first()
    assert run["hit1"] == 1.0 and run["refusal_rate"] == 1.0 and run["answered_rate"] == 1.0 and run["subsection_evidence"] == 1.0 and run["citation_precision"] == 1.0 and run["groundedness"] > 0
    shown = engine.report()
    assert "## Answers" in shown and "| g1 | False | False |" in shown and engine.latest_report()["runs"][0]["config"] == "hybrid_rerank"
    with engine._evaluating, pytest.raises(RuntimeError):
        engine.evaluate(golden)


def test_publications_and_manifests(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("documents:\n- {slug: OSHA3151, title: Gloves, url: u, kind: booklet}\n")
    manifest = tables.publications(spark, str(tmp_path / "m.yaml"))
    pages = spark.createDataFrame([("OSHA3151", k, "12" if k == 2 else f"Text of page {k}.") for k in range(1, 6)], "slug string, page int, text string")
    got = {r["section_id"]: r for r in cleaning.publication_sections(pages, manifest).collect()}
    assert set(got) == {"OSHA 3151 (pp. 1-4)", "OSHA 3151 (p. 5)"} and got["OSHA 3151 (p. 5)"]["part"] == "OSHA-BOOKLET" and got["OSHA 3151 (pp. 1-4)"]["text"].count("\n") == 2
    assert got["OSHA 3151 (p. 5)"]["parent_path"] == "OSHA Publications › Gloves"
    (tmp_path / "bad.json").write_text("{")
    assert tables.read_json(spark, str(tmp_path / "bad.json")) == {} == tables.read_json(spark, str(tmp_path / "none.json"))
    (tmp_path / "titles.json").write_text('{"titles": [{"number": 29, "up_to_date_as_of": "2026-01-02"}]}')
    assert tables.issue_date(spark, str(tmp_path / "titles.json"), 29) == "2026-01-02"
    with pytest.raises(ValueError):
        tables.issue_date(spark, str(tmp_path / "titles.json"), 1)


def test_logs_timings_and_backends():
    record = obs.logging.LogRecord("quern", 20, "f", 1, "done", None, None)
    record.fields = {"n": 3}
    assert json.loads(obs.JsonLines().format(record)) | {"ts": 0} == {"ts": 0, "level": "info", "event": "done", "n": 3}
    timings = []
    with pytest.raises(ValueError), obs.timed(timings, "x"):
        raise ValueError
    assert timings[0]["stage"] == "x" and timings[0]["ms"] >= 0
    assert models.answerer("extractive") is models.answerer("extractive")
    with pytest.raises(ValueError):
        models.answerer("none")


def test_citation_edges(spark):
    span = lambda x: one(spark, x, lambda c: F.array(*C.pages(c)))
    assert span("OSHA 3151 (pages 4-6)") == [4, 6] and span("OSHA 3151 (p. 9)") == [9, 9] and span("29 CFR 1910 (pp. 1-2)") == [None, None]
    assert one(spark, "\t some id\u00a0", C.normalise) == "some id"
    chain = lambda text, *m: one(spark, text, lambda c: C.chain_exists(c, F.array(*[F.lit(x) for x in m])))
    assert chain("( B ) x (1) (2)", "b", "2") and not chain("(1) (b)", "b", "1") and not chain("(bx)", "b.") and not chain("(b) " * 20_000, "b", "b", "b", "z")
    keys = one(spark, "OSHA 3151 (pp. 4-6)", retrieval.id_keys)
    assert keys == ["OSHA", "OSHA 3151", "OSHA 3151 (pp.", "OSHA 3151 (pp. 4-6)"]
