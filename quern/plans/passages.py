"""Queries of the scorer by passages, on the first 24 documents that BM25 finds for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import passages
from quern.operators.retrieval import bm25_search, spread
from quern.plans import retrieval as plans
from quern.plans.registry import query
from quern.plans.retrieval import BM25, words
from quern.sources.tables import parquet, saver

#: How many documents a question are scored.
POOL = 24

_SPANS = f"""{BM25},
    po AS (SELECT qid, id, sparse_rank FROM bm WHERE sparse_rank <= {POOL}),
    qw AS (SELECT item_id AS qid, list_distinct(w) AS d, w FROM (SELECT item_id, {words("text")} AS w FROM benchmark)),
    qk AS (SELECT qid, t, list_position(w, t) AS k FROM (SELECT qid, w, unnest(d) AS t FROM qw)),
    dp AS (SELECT doc_id AS id, unnest(w) AS t, unnest(range(len(w))) AS p FROM dw SEMI JOIN po ON po.id = dw.doc_id),
    hi AS (SELECT po.qid, po.id, k, p FROM po JOIN qk ON qk.qid = po.qid JOIN dp ON dp.id = po.id AND dp.t = qk.t),
    te AS (SELECT DISTINCT qid, id, k FROM hi),
    en AS (SELECT h.qid, h.id, h.p AS e, te.k FROM (SELECT DISTINCT qid, id, p FROM hi) h JOIN te ON te.qid = h.qid AND te.id = h.id),
    la AS (SELECT en.qid, en.id, en.e, en.k, hi.p AS last FROM en ASOF LEFT JOIN hi ON en.qid = hi.qid AND en.id = hi.id AND en.k = hi.k AND en.e >= hi.p),
    wi AS (SELECT qid, id, e, e - min(last) + 1 AS width, count(*) AS m FROM la GROUP BY qid, id, e HAVING count(last) = count(*)),
    be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY width, e) AS n FROM wi) WHERE n = 1),
    fo AS (SELECT qid, id, count(*) FILTER (back < last) AS forward FROM (SELECT la.*, lag(last) OVER (PARTITION BY la.qid, la.id ORDER BY k) AS back FROM la SEMI JOIN be ON be.qid = la.qid AND be.id = la.id AND be.e = la.e) GROUP BY qid, id),
    fe AS (SELECT po.qid, po.id, sparse_rank, m / len(d) AS coverage, m / width AS density, CASE WHEN m > 1 THEN forward / (len(d) - 1) ELSE 0 END AS ord
           FROM po JOIN be ON be.qid = po.qid AND be.id = po.id JOIN fo ON fo.qid = po.qid AND fo.id = po.id JOIN qw ON qw.qid = po.qid)"""


def scored(candidates: DataFrame, asked: DataFrame, docs: DataFrame) -> DataFrame:
    """``qid, id, sparse_rank`` and the features of each of ``candidates`` over its whole text."""
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    both = candidates.select("qid", "id", "sparse_rank").join(texts, "id").join(asked.select("qid", "text"), "qid")
    # few bytes, long folds
    return spread(both, "qid", "id").select("qid", "id", "sparse_rank", passages.features(F.col("text"), F.col("body")).alias("f")).select("qid", "id", "sparse_rank", "f.*")


@query(f"""WITH {_SPANS}, sc AS (SELECT *, round(1 / (1 + exp(-(-8.0::DOUBLE + 6 * coverage + 4 * density + 2 * ord))), 10) AS s FROM fe)
    SELECT qid, id, round(coverage, 6) AS coverage, round(density, 6) AS density, round(ord, 6) AS "order", round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, sparse_rank)::INTEGER AS place FROM sc""")
def passage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of each question in the order of the scorer with its given weights, and what it looks at."""
    pool = scored(plans._bm25(spark, sf_dir, POOL), plans._asked(spark, sf_dir), parquet(spark, sf_dir, "documents"))
    made = saver(spark)(pool)  # read by the ranking and for the features
    best = passages.rescored(made, passages.Weights(), POOL)
    return best.join(made, ["qid", "id"]).select("qid", "id", *[F.round(c, 6).alias(c) for c in (*passages.FEATURES, "score")], "place")


def short_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, text, held_out``: of each benchmark item every second of its content words from the third on, six of them; questions of odd checksum are held out."""
    asked = plans._asked(spark, sf_dir)
    w = T.content_words(F.col("text"))
    six = F.slice(F.filter(F.transform(w, lambda x, i: F.when((i >= 2) & (i % 2 == 0), x)), lambda x: x.isNotNull()), 1, 6)
    return asked.select("qid", F.array_join(six, " ").alias("text"), (F.crc32(F.col("qid").cast("string").cast("binary")) % 2 == 1).alias("held_out"))


def judged(asked: DataFrame, docs: DataFrame, index: dict[str, DataFrame], relevant: DataFrame) -> DataFrame:
    """The features of every pooled pair of the questions ``asked (qid, text, held_out)``, ``held_out``, and ``relevant``: the pair is in ``relevant (qid, id)``."""
    pairs = scored(bm25_search(index, asked, POOL), asked, docs)
    marked = pairs.join(relevant.select("qid", "id", F.lit(True).alias("relevant")), ["qid", "id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    return marked.join(asked.select("qid", "held_out"), "qid")


@query()
def passage_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held-out short questions' pools, scored with weights that are fitted on the other questions."""
    pairs = saver(spark)(judged(short_questions(spark, sf_dir), parquet(spark, sf_dir, "documents"), plans._index(spark, sf_dir), plans._relevant(spark, sf_dir)))
    weights = passages.fit(pairs.filter("not held_out"))
    return passages.rescored(pairs.filter("held_out"), weights, POOL)
