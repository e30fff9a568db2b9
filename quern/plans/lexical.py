"""Search with stems, without most postings, after a refresh, by cells of vectors and by learned factors; sections from markup."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import stems as S
from quern.functions import text as T
from quern.operators import cleaning, factors, ivf, pruned, retrieval
from quern.plans import retrieval as plans
from quern.plans.registry import ORACLES, query
from quern.sources import markup, segments
from quern.sources.tables import parquet, saver, work_dir


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _swap(endings: dict[str, str]) -> str:
    return "CASE e " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in endings.items()) + " END"


def search_words(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_list(T.SEARCH_STOP_WORDS)}, w))"


def stems_sql(vocabulary: str) -> str:
    """Common table expressions from ``vocabulary (term)`` to ``stems (term, stem)``, a step for each rule."""
    cut = lambda n: f"left(w, length(w) - {n})"
    has = lambda x, p: f"regexp_matches({x}, '{p}')"
    end = lambda endings: f"regexp_extract(w, '{S.either(endings)}', 1)"
    region = f"'{S.REGION}'"
    double, special = S.either(S.DOUBLES), "CASE term " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.SPECIAL.items()) + " END"
    base = "(length(w) - length(e))"

    def step(n, endings):
        return f""", t{n} AS (SELECT *, {end(endings)} AS e FROM w{n - 1}), w{n} AS (SELECT * EXCLUDE (e) REPLACE (CASE WHEN NOT done AND e <> '' AND {base} >= r1
            AND (CASE e WHEN 'ogi' THEN {has("w", "logi$")} WHEN 'li' THEN {has("w", S.BEFORE_LI + "li$")} WHEN 'ative' THEN {base} >= r2 ELSE true END) THEN left(w, {base}) || {_swap(endings)} ELSE w END AS w) FROM t{n})"""

    return f"""
        a0 AS (SELECT term, regexp_replace(regexp_replace(regexp_replace(term, '^''', ''), '^y', 'Y'), '({S.VOWEL})y', '\\1Y', 'g') AS w FROM {vocabulary}),
        a1 AS (SELECT *, regexp_extract(w, '^(?:{"|".join(S.LONG_PREFIXES)})|{S.REGION}') AS f FROM a0),
        a2 AS (SELECT term, w, CASE WHEN f <> '' THEN length(f) ELSE length(w) END AS r1 FROM a1),
        a3 AS (SELECT *, regexp_extract(substr(w, r1 + 1), {region}) AS f FROM a2),
        a4 AS (SELECT term, regexp_replace(w, '(''s''|''s|'')$', '') AS w, r1, CASE WHEN f <> '' THEN r1 + length(f) ELSE length(w) END AS r2 FROM a3),
        a5 AS (SELECT *, {end(("sses", "ied", "ies", "us", "ss", "s"))} AS e FROM a4),
        a6 AS (SELECT * EXCLUDE (e) REPLACE (CASE WHEN e = 'sses' THEN {cut(2)} WHEN e IN ('ied', 'ies') THEN CASE WHEN length(w) > 4 THEN {cut(2)} ELSE {cut(1)} END WHEN e = 's' AND {has("w", S.VOWEL + ".+s$")} THEN {cut(1)} ELSE w END AS w) FROM a5),
        a7 AS (SELECT *, list_contains({_list(S.FINISHED)}, w) AS done, {end(("eedly", "ingly", "edly", "eed", "ing", "ed"))} AS e FROM a6),
        a8 AS (SELECT *, left(w, {base}) AS b FROM a7),
        a9 AS (SELECT * EXCLUDE (e, b) REPLACE (CASE WHEN done THEN w WHEN e IN ('eed', 'eedly') THEN CASE WHEN {base} >= r1 THEN b || 'ee' ELSE w END WHEN e <> '' AND {has("b", S.VOWEL)}
            THEN CASE WHEN {has("b", "(?:at|bl|iz)$")} THEN b || 'e' WHEN {has("b", double)} THEN left(b, length(b) - 1) WHEN length(b) <= r1 AND {has("b", S.SHORT_SYLLABLE)} THEN b || 'e' ELSE b END ELSE w END AS w) FROM a8),
        w1 AS (SELECT * REPLACE (CASE WHEN NOT done AND {has("w", f"^.+{S.CONSONANT}[yY]$")} THEN {cut(1)} || 'i' ELSE w END AS w) FROM a9){step(2, S.ENDINGS_2)}{step(3, S.ENDINGS_3)},
        t4 AS (SELECT *, {end(S.ENDINGS_4)} AS e FROM w3),
        w4 AS (SELECT * EXCLUDE (e) REPLACE (CASE WHEN NOT done AND e <> '' AND {base} >= r2 AND (e <> 'ion' OR {has("w", "[st]ion$")}) THEN left(w, {base}) ELSE w END AS w) FROM t4),
        w5 AS (SELECT term, lower(CASE WHEN NOT done AND ({has("w", "e$")} AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT {has(cut(1), S.SHORT_SYLLABLE)}) OR {has("w", "ll$")} AND length(w) - 1 >= r2) THEN {cut(1)} ELSE w END) AS w FROM w4),
        stems AS (SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE coalesce({special}, w) END AS stem FROM w5)"""


_DOCUMENT_WORDS = f"cut AS (SELECT doc_id, {search_words('text')} AS w FROM documents)"


@query(f"""WITH {_DOCUMENT_WORDS}, vocabulary AS (SELECT DISTINCT unnest(w) AS term FROM cut), {stems_sql("vocabulary")} SELECT term, stem FROM stems""")
def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every word of the documents."""
    words = parquet(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.search_words(F.col("text")))).alias("term")).distinct()
    return S.with_stems(words)


_STEMMED = f"""{_DOCUMENT_WORDS}, asked AS (SELECT item_id, {search_words('text')} AS w FROM benchmark),
    vocabulary AS (SELECT DISTINCT term FROM (SELECT unnest(w) AS term FROM cut UNION ALL SELECT unnest(w) FROM asked)), {stems_sql("vocabulary")},
    tf AS (SELECT doc_id, stem AS t, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM cut) JOIN stems USING (term) GROUP BY doc_id, stem),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM cut),
    qt AS (SELECT DISTINCT item_id AS qid, stem AS t FROM (SELECT item_id, unnest(w) AS term FROM asked) JOIN stems USING (term)),
    bs AS (SELECT qid, doc_id AS id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM qt JOIN tf USING (t) JOIN df USING (t), st GROUP BY qid, doc_id)"""


@query(f"""WITH {_STEMMED} SELECT qid, id, round(score, 6) AS sparse_score, sparse_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, id) AS sparse_rank FROM bs) WHERE sparse_rank <= 30""")
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 30 documents of each question by stems."""
    return retrieval.bm25_search(_index(spark, sf_dir), plans._asked(spark, sf_dir), 30, stemmed=True)


#: Where the indexes of this process's sessions lie.
_INDEXES: dict = {}


def _index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir, "stemmed")
    if key not in _INDEXES:
        path = f"{work_dir(spark)}/stemmed-{uuid.uuid4().hex}"
        retrieval.write_bm25(parquet(spark, sf_dir, "documents"), path, stemmed=True)
        _INDEXES[key] = path
    return retrieval.load_bm25(spark, _INDEXES[key])


def impacts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir, "impacts")
    if key not in _INDEXES:
        path = f"{work_dir(spark)}/impacts-{uuid.uuid4().hex}"
        pruned.write_impacts(plans._index(spark, sf_dir), path)
        _INDEXES[key] = path
    return pruned.load_impacts(spark, _INDEXES[key])


@query(ORACLES["bm25_topk"])
def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bm25_topk`` by opened blocks alone."""
    return pruned.search(impacts(spark, sf_dir), plans._asked(spark, sf_dir), 30, save=saver(spark))


@query(ORACLES["bm25_topk"])
def bm25_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bm25_topk`` on an index whose first segment had other texts, lacked some documents and had some that are gone, before a refresh."""
    docs = parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    key = (spark.sparkContext.applicationId, sf_dir, "segments")
    if key not in _INDEXES:
        path = f"{work_dir(spark)}/segments-{uuid.uuid4().hex}"
        old = F.when(F.col("chunk_id") % 10 == 0, F.concat(F.lit("an earlier text "), "text")).otherwise(F.col("text"))
        gone = docs.select((F.col("chunk_id") + 10**12).alias("chunk_id"), "text").filter(F.col("chunk_id") % 5 == 0)
        no_vector = lambda text: F.array().cast("array<double>")
        first = docs.filter("chunk_id % 7 <> 0").select("chunk_id", old.alias("text")).unionByName(gone)
        held, _ = segments.refresh(spark, path, [], first, no_vector)
        held, _ = segments.refresh(spark, path, held, docs, no_vector)
        _INDEXES[key] = (path, held)
    path, held = _INDEXES[key]
    return retrieval.bm25_search(segments.tables(spark, path, held, "bigint"), plans._asked(spark, sf_dir), 30)


@query(r"""WITH d AS (SELECT doc_id, lang, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents)
    SELECT '29 CFR 1910.' || doc_id AS section_id, '1910' AS part, '29 CFR 1910 › Subpart ' || lang || ' › ' || source AS parent_path, 'Of ' || source AS heading, md5(body) AS text FROM d WHERE length(body) >= 120""")
def xml_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of regulation markup that is made of the documents and read in parts."""
    docs = parquet(spark, sf_dir, "documents")
    plain = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    made = F.concat(F.lit('<DIV5 N="1910" TYPE="PART"><DIV6 TYPE="SUBPART"><HEAD>Subpart '), plain("lang"), F.lit('</HEAD><DIV7 TYPE="SUBJGRP"><HEAD>'), plain("source"), F.lit('</HEAD><DIV8 TYPE="SECTION" N="1910.'), F.col("doc_id").cast("string"), F.lit('"><HEAD>§ 1910.'), F.col("doc_id").cast("string"), F.lit(" Of "), plain("source"), F.lit("</HEAD><P>"), plain("text"), F.lit("</P></DIV8></DIV7></DIV6></DIV5>"))
    path = f"{work_dir(spark)}/markup-{uuid.uuid4().hex}"
    docs.select(made.alias("value")).write.text(path)
    found = cleaning.name_units(markup.units(spark, path, "*"), markup.ORDER)
    return found.select("section_id", "part", "parent_path", "heading", F.md5("text").alias("text"))


def _cells(spark: SparkSession, sf_dir: str) -> dict:
    key = (spark.sparkContext.applicationId, sf_dir, "cells")
    if key not in _INDEXES:
        path = f"{work_dir(spark)}/cells-{uuid.uuid4().hex}"
        ivf.write_ivf(parquet(spark, sf_dir, "embeddings"), path)
        _INDEXES[key] = path
    return ivf.load_ivf(spark, _INDEXES[key])


def _vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


@query()
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 nearest of each vector among the cells nearest to it; approximate, its recall is tested."""
    return ivf.search(_cells(spark, sf_dir), _vector_questions(spark, sf_dir), 30)


@query(ORACLES["dense_topk"])
def ivf_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index searched in all cells with all candidates scored again: ``dense_topk``."""
    return ivf.search(_cells(spark, sf_dir), _vector_questions(spark, sf_dir), 30, probes=ivf.Params.cells, refine=ivf.Params.block_rows)


@query()
def factors_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 documents nearest to each question in the space of factors learned from the documents."""
    docs, asked = parquet(spark, sf_dir, "documents"), plans._asked(spark, sf_dir)
    made = factors.train(docs, save=saver(spark))
    vectors = docs.select("doc_id", factors.embedding(F.col("text"), made).alias("vector"))
    questions = asked.select("qid", factors.embedding(F.col("text"), made).alias("vector"))
    return retrieval.dense_topk(vectors, questions, 30, "doc_id", "vector")
