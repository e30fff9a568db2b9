"""Retrieval and evaluation queries: benchmark items are questions, documents the corpus, embeddings the vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions import text as T
from quern.operators import chunking, evaluation, retrieval
from quern.plans.corpus import count_of, sentences_of
from quern.plans.registry import query
from quern.sources.tables import parquet, saver, work_dir

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def words(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w))"


BM25 = f"""
    dw AS (SELECT doc_id, {words("text")} AS w FROM documents),
    tf AS (SELECT doc_id, t, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM dw) GROUP BY doc_id, t),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dw),
    qt AS (SELECT DISTINCT item_id AS qid, t FROM (SELECT item_id, unnest({words("text")}) AS t FROM benchmark)),
    bs AS (SELECT qid, doc_id AS id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
           FROM qt JOIN tf USING (t) JOIN df USING (t), st GROUP BY qid, doc_id),
    bm AS (SELECT qid, id, round(score, 6) AS sparse_score, sparse_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, id) AS sparse_rank FROM bs) WHERE sparse_rank <= 30)"""


def dense(queries: str) -> str:
    return f"""
    ds AS (SELECT q.vec_id AS qid, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM ({queries}) q, embeddings v),
    dn AS (SELECT qid, id, round(score, 6) AS dense_score, dense_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, id) AS dense_rank FROM ds) WHERE dense_rank <= 30)"""


ITEMS = "SELECT e.* FROM embeddings e JOIN benchmark b ON b.item_id = e.vec_id"
FUSED = f"""{BM25}, {dense(ITEMS)},
    fu AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.id, s.id) AS id, dense_score, dense_rank, sparse_score, sparse_rank,
                  coalesce(0.65::DOUBLE / (60 + dense_rank), 0) + coalesce(0.35::DOUBLE / (60 + sparse_rank), 0) AS rrf
           FROM dn d FULL JOIN bm s ON d.qid = s.qid AND d.id = s.id),
    ok AS (SELECT fu.* FROM fu SEMI JOIN documents ON documents.doc_id = fu.id)"""


def _asked(spark, sf_dir):
    return parquet(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


#: Where the indexes of this process's sessions lie.
_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark, sf_dir):
    """The BM25 tables of the documents, written by the session's first query that asks for them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = f"{work_dir(spark)}/bm25-{uuid.uuid4().hex}"
        retrieval.write_bm25(parquet(spark, sf_dir, "documents"), path)
        _INDEXES[key] = path
    return retrieval.load_bm25(spark, _INDEXES[key])


def _bm25(spark, sf_dir, k=30):
    return retrieval.bm25_search(_index(spark, sf_dir), _asked(spark, sf_dir), k)


def _dense(spark, sf_dir, k=30):
    vectors = parquet(spark, sf_dir, "embeddings")
    asked = vectors.join(_asked(spark, sf_dir).select(F.col("qid").alias("vec_id")), "vec_id", "left_semi")
    return retrieval.dense_topk(vectors, asked.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), k)


def _fused(spark, sf_dir):
    both = retrieval.fuse(_dense(spark, sf_dir), _bm25(spark, sf_dir))
    return retrieval.in_store(both, parquet(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {BM25} SELECT qid, id, sparse_score, sparse_rank FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir)


@query(f"WITH {dense('SELECT * FROM embeddings')} SELECT qid, id, dense_score, dense_rank FROM dn")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = parquet(spark, sf_dir, "embeddings")
    return retrieval.dense_topk(vectors, vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), 30)


@query("SELECT d.doc_id, e.vec_id IS NOT NULL AS found, e.label, md5(array_to_string(list_transform(e.embedding, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ',')) AS vector FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def vector_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, vectors = parquet(spark, sf_dir, "documents").select("doc_id"), parquet(spark, sf_dir, "embeddings")
    return ids.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", F.col("vec_id").isNotNull().alias("found"), "label", F.md5(F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")), ",")).alias("vector"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS before,
          round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12)) ** 2))), 6) AS after FROM embeddings""")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = lambda c: F.round(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 6)
    return parquet(spark, sf_dir, "embeddings").select("vec_id", norm(F.col("embedding")).alias("before"), norm(T.l2_normalise(F.col("embedding"))).alias("after"))


@query(f"WITH {FUSED} SELECT qid, id, dense_score, dense_rank, sparse_score, sparse_rank, round(rrf, 6) AS rrf FROM ok")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("qid", "id", "dense_score", "dense_rank", "sparse_score", "sparse_rank", F.round("rrf", 6).alias("rrf"))


#: The exact hit of a question is the document of its number.
_BOOSTED = f"""{FUSED}, bo AS (SELECT *, qid = id AS exact, rrf + CASE WHEN qid = id THEN 1.0 ELSE 0.0 END AS score FROM ok),
    od AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, id) AS pos FROM bo)"""


def _ordered(spark, sf_dir):
    exact = _asked(spark, sf_dir).select("qid", F.col("qid").alias("id"))
    return retrieval.in_order(retrieval.boost(_fused(spark, sf_dir), exact))


@query(f"WITH {_BOOSTED} SELECT qid, id, round(score, 6) AS rrf, exact, pos FROM od")
def rrf_exact_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("qid", "id", F.round("rrf", 6).alias("rrf"), "exact", "pos")


_SECTIONED = f"{_BOOSTED}, se AS (SELECT od.*, source AS section FROM od JOIN documents ON doc_id = id)"


def _sectioned(spark, sf_dir):
    docs = parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section"))
    return _ordered(spark, sf_dir).join(docs, "id")


@query(f"""WITH {_SECTIONED}, c AS (SELECT *, row_number() OVER (PARTITION BY qid, section ORDER BY pos) AS k FROM se),
    p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS place FROM c WHERE k <= 2) SELECT qid, id, section, place FROM p WHERE place <= 24""")
def section_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.section_cap(_sectioned(spark, sf_dir)).select("qid", "id", "section", "place")


@query(f"""WITH {FUSED}, m AS (SELECT qid, id, rrf, min(rrf) OVER (PARTITION BY qid) AS lo, max(rrf) OVER (PARTITION BY qid) AS hi FROM ok)
    SELECT qid, id, round(CASE WHEN hi > lo THEN (rrf - lo) / (hi - lo) ELSE 1.0 END, 6) AS relevance FROM m""")
def pool_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("qid", "id", F.round(retrieval.min_max("rrf"), 6).alias("relevance"))


_UNIT = "list_transform(e.embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) + 1e-12))"


@query(f"""WITH {_SECTIONED}, n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS i, count(*) OVER (PARTITION BY qid) AS n FROM se WHERE pos <= 24),
    p AS (SELECT qid, list(id ORDER BY i) AS ids, list(section ORDER BY i) AS secs, list(1 - (pos - 1) / greatest(n - 1, 1) ORDER BY i) AS rel, list({_UNIT} ORDER BY i) AS v, max(n) AS n FROM n LEFT JOIN embeddings e ON e.vec_id = id GROUP BY qid),
    t AS (SELECT *, list_reduce(list_transform(range(7), lambda x: []::BIGINT[]), lambda s, x: list_concat(s, coalesce([list_aggregate(list_transform(list_filter(range(1, n + 1), lambda i: v[i] IS NOT NULL AND NOT list_contains(s, i) AND len(list_filter(s, lambda u: secs[u] = secs[i])) < 2),
             lambda i: {{'w': CASE WHEN len(s) = 0 THEN rel[i] ELSE 0.7::DOUBLE * rel[i] - 0.3::DOUBLE * list_max(list_transform(s, lambda u: list_dot_product(v[i], v[u]))) END, 'b': -i}}), 'max')], []::STRUCT(w DOUBLE, b BIGINT)[]).list_filter(lambda x: x IS NOT NULL).list_transform(lambda x: -x.b))) AS taken FROM p),
    f AS (SELECT qid, ids, list_concat(taken, list_slice(list_filter(range(1, n + 1), lambda i: NOT list_contains(taken, i)), 1, greatest(6 - len(taken), 0))) AS c FROM t)
    SELECT qid, unnest(list_transform(c, lambda i: ids[i])) AS id, unnest(range(1, len(c) + 1))::INTEGER AS place FROM f""")
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six diverse documents a question out of the first 24, at most two of a source."""
    vectors = parquet(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pool = _sectioned(spark, sf_dir).filter("pos <= 24").join(vectors, "id", "left").withColumn("relevance", retrieval.rank_relevance())
    return retrieval.mmr(pool)


def _hits(spark, sf_dir, k=6):
    docs = parquet(spark, sf_dir, "documents")
    return retrieval.with_parents(_ordered(spark, sf_dir).filter(F.col("pos") <= k), docs, "doc_id", "text").join(_asked(spark, sf_dir).withColumnRenamed("text", "query"), "qid")


@query(f"WITH {_BOOSTED} SELECT od.qid, od.id, pos AS rank, round(score, 6) AS rrf, length(text) AS parent_chars, left(text, 1600) AS excerpt FROM od JOIN documents ON doc_id = id WHERE pos <= 6")
def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("qid", "id", F.col("pos").alias("rank"), F.round("rrf", 6).alias("rrf"), F.length("parent_text").alias("parent_chars"), "excerpt")


def _coverage(question: str, text: str) -> str:
    return f"CASE WHEN len(list_distinct({words(question)})) > 0 THEN len(list_intersect(list_distinct({words(question)}), {words(text)})) / len(list_distinct({words(question)})) ELSE 0 END"


@query(f"""WITH {_BOOSTED}, sc AS (SELECT od.*, CASE WHEN pos <= 24 THEN {_coverage("b.text", "left(d.text, 400)")} END AS coverage FROM od JOIN documents d ON doc_id = id JOIN benchmark b ON item_id = qid)
    SELECT qid, id, round(coverage, 6) AS rerank_score, row_number() OVER (PARTITION BY qid ORDER BY round(CASE WHEN exact THEN 1e6 ELSE 0 END + coalesce(coverage, -1e9) + 10 * score, 8) DESC, pos) AS pos FROM sc""")
def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool scored offline (coverage of the question's words by the first 400 characters), and all candidates in the new order."""
    docs = parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 400).alias("head"))
    found = _ordered(spark, sf_dir).join(docs, "id").join(_asked(spark, sf_dir), "qid")
    score = T.overlap(T.content_words(F.col("text")), T.content_words(F.col("head")))
    return retrieval.rerank(found, score, 24).select("qid", "id", F.round("rerank_score", 6).alias("rerank_score"), "pos")


_EVIDENCE = f"""{_BOOSTED}, top AS (SELECT od.*, d.text FROM od JOIN documents d ON doc_id = id WHERE pos <= 6),
    ev AS (SELECT b.item_id AS qid, any_value(b.text) AS q, max(dense_score) AS max_cos, bool_or(exact) AS exact,
                  flatten(list({words("left(top.text, 4000)")}) FILTER (WHERE pos <= 3)) AS tw
           FROM benchmark b JOIN top ON top.qid = b.item_id GROUP BY b.item_id),
    ov AS (SELECT qid, coalesce(max_cos, 0) AS max_cos, exact, CASE WHEN len(list_distinct({words("q")})) > 0 THEN len(list_intersect(list_distinct({words("q")}), tw)) / len(list_distinct({words("q")})) ELSE 0.0 END AS overlap FROM ev),
    gr AS (SELECT *, round(0.5::DOUBLE * greatest(0, max_cos) + 0.4::DOUBLE * overlap + 0.1::DOUBLE * exact::INT, 6) AS grounding FROM ov)"""


def _evidence(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    own = T.content_words(F.substring("parent_text", 1, 4000))
    # six hits a question
    grouped = hits.groupBy("qid").agg(F.max("dense_score").alias("max_cos"), F.max("exact").alias("exact"), F.first("query").alias("query"), F.flatten(F.collect_list(F.when(F.col("pos") <= 3, own))).alias("seen"))
    return grouped.select("qid", "query", F.coalesce("max_cos", F.lit(0.0)).alias("max_cos"), "exact", T.overlap(T.content_words(F.col("query")), F.col("seen")).alias("overlap"), F.lit(None).cast("double").alias("rerank_best"))


@query(f"WITH {_EVIDENCE} SELECT qid, round(overlap, 6) AS overlap FROM ov")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("qid", F.round("overlap", 6).alias("overlap"))


@query(f"""WITH {_EVIDENCE} SELECT qid, grounding, grounding < 0.52 OR (overlap < 0.06 AND NOT exact) AS refused,
    CASE WHEN overlap < 0.06 AND NOT exact THEN 'out_of_domain' WHEN grounding < 0.52 THEN 'low_grounding' END AS reason FROM gr""")
def grounding_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.guard(_evidence(spark, sf_dir)).select("qid", "grounding", "refused", "reason")


def _packed(body: str, room: str) -> str:
    """What ``chunking.pack`` gives, as nested folds."""
    each = lambda lines, x: f"list_transform({lines}, lambda {x}: {{'kept': [{x}], 'left': {count_of(x)}::BIGINT, 'done': false}})"
    more = lambda h, p: f"{{'kept': list_concat({h}.kept, {p}.kept), 'left': {h}.left - {p}.left, 'done': false}}"
    cut = f"CASE WHEN len(g.kept) = 0 AND g.left = {room} THEN [left(q.kept[1], floor(length(q.kept[1]) * {room} / q.left)::BIGINT) || ' [...]'] ELSE g.kept END"
    inner = f"list_reduce(list_prepend(h, {each(sentences_of('p.kept[1]'), 'y')}), lambda g, q: CASE WHEN g.done THEN g WHEN q.left <= g.left THEN {more('g', 'q')} ELSE {{'kept': {cut}, 'left': g.left, 'done': true}} END)"
    zero = f"{{'kept': []::VARCHAR[], 'left': {room}::BIGINT, 'done': false}}"
    fold = f"list_reduce(list_prepend({zero}, {each(f'string_split({body}, chr(10))', 'x')}), lambda h, p: CASE WHEN h.done THEN h WHEN p.left <= h.left THEN {more('h', 'p')} ELSE {{'kept': ({inner}).kept, 'left': h.left, 'done': true}} END)"
    return f"CASE WHEN {count_of(body)} <= {room} THEN {{'text': {body}, 'cut': false}} ELSE {{'text': array_to_string(({fold}).kept, chr(10)), 'cut': true}} END"


_ITEM = "STRUCT(id VARCHAR, text VARCHAR, block VARCHAR)[]"


@query(f"""WITH {_BOOSTED},
    h AS (SELECT od.qid, list({{'out': [{{'id': od.id::VARCHAR, 'text': d.text, 'block': '### [' || od.id || '] ' || d.lang || chr(10) || '(path: ' || d.source || '; source: ' || d.source || ')' || chr(10)}}], 'left': 0::BIGINT, 'done': false}} ORDER BY pos) AS hits
          FROM od JOIN documents d ON doc_id = od.id WHERE pos <= 6 GROUP BY od.qid),
    f AS (SELECT qid, list_reduce(list_prepend({{'out': []::{_ITEM}, 'left': 2400::BIGINT, 'done': false}}, hits), lambda a, b: CASE WHEN a.done OR a.left - {count_of("b.out[1].block")} < 60 THEN {{'out': a.out, 'left': a.left, 'done': true}}
          ELSE list_transform(list_transform([a.left - {count_of("b.out[1].block")}], lambda r: {_packed("b.out[1].text", "r")}), lambda z: list_transform([b.out[1].block || z.text || CASE WHEN z.cut THEN chr(10) || '[...remainder of this section omitted to fit the context budget...]' ELSE '' END],
               lambda blk: {{'out': list_append(a.out, {{'id': b.out[1].id, 'text': z.text, 'block': blk}}), 'left': a.left - {count_of("blk")}, 'done': false}})[1])[1] END).out AS o FROM h)
    SELECT qid, md5(array_to_string(list_transform(o, lambda x: x.block), chr(10) || chr(10) || '---' || chr(10) || chr(10))) AS context, array_to_string(list_transform(o, lambda x: x.id), ',') AS included,
           length(array_to_string(list_transform(o, lambda x: x.block), chr(10) || chr(10) || '---' || chr(10) || chr(10))) AS chars FROM f""")
def pack_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of every question, packed under the token budget."""
    hits = _hits(spark, sf_dir).join(parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source"), "id")
    rows = hits.select("qid", F.col("pos").alias("place"), F.col("id").cast("string").alias("section"), F.col("lang").alias("heading"), F.col("source").alias("path"), "source", F.col("parent_text").alias("body"))
    out = chunking.assemble(rows)
    return out.select("qid", F.md5("context").alias("context"), F.array_join("included", ",").alias("included"), F.length("context").alias("chars"))


def _keys(text):
    """Whole inner words of an item's text, which whoever holds the text has, too; of a text without, its stretches of three characters (all of a shorter one) behind a space, which no word has."""
    inner = F.slice(_tokens(text), F.lit(2), F.greatest(F.size(_tokens(text)) - 2, F.lit(0)))
    size = F.least(F.length(text), F.lit(3))
    grams = F.when(size == 3, _grams(text, 3)).when(size == 2, _grams(text, 2)).when(size == 1, _grams(text, 1)).otherwise(_grams(text, 0))
    return F.when(F.size(inner) > 0, F.array_distinct(inner)).otherwise(grams)


def _tokens(text):
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def _grams(text, n):
    if n == 0:
        return F.array(F.lit(" "))
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))), lambda g: F.concat(F.lit(" "), g))


def _relevant(spark, sf_dir):
    """Documents that hold an item's text, however short it is. A pair must share the rarest of the text's ``_keys``, so only those are compared."""
    docs, items = parquet(spark, sf_dir, "documents"), _asked(spark, sf_dir).filter("text is not null").withColumn("of", F.xxhash64("text"))
    own = items.select("qid", "of", F.explode(_keys(F.col("text"))).alias("w"))
    # texts are cut into stretches only if an item without inner words asks for that length
    sizes = [r[0] for r in own.filter("w like ' %'").select(F.length("w") - 1).distinct().collect()]  # four at most
    each = F.concat(F.array_distinct(_tokens(F.col("text"))), *[_grams(F.col("text"), n) for n in sizes])
    # read by the counts and the pairs; no key of a text that no item has is shuffled
    held = saver(spark)(retrieval.some(docs.select("doc_id", F.explode(each).alias("w")), "w", own, "w").join(own.select(F.col("w").alias("own")).distinct(), F.col("w") == F.col("own"), "left_semi"))
    df = held.groupBy("w").agg(F.count("*").alias("df"))
    rarest = saver(spark)(own.join(df, "w").groupBy("qid", "of").agg(F.min(F.struct("df", "w")).getField("w").alias("w")))
    pairs = saver(spark)(rarest.join(retrieval.some(held, "w", rarest, "w"), "w").select("qid", "of", "doc_id"))
    texts = retrieval.some(docs.select("doc_id", F.col("text").alias("d")), "doc_id", pairs, "doc_id")
    return pairs.join(texts, "doc_id").join(items, ["qid", "of"]).filter(F.contains(F.col("d"), F.col("text"))).select("qid", F.col("doc_id").alias("id")).distinct()


_RELEVANT = "re AS (SELECT DISTINCT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _metrics(ranking: str, rank: str) -> str:
    return f"""
    f AS (SELECT r.qid, min({rank}) AS best, sum(1 / log2({rank} + 1)) AS dcg FROM {ranking} r SEMI JOIN re ON re.qid = r.qid AND re.id = r.id WHERE {rank} <= 10 GROUP BY r.qid),
    w AS (SELECT qid, count(*) AS n FROM re GROUP BY qid),
    pi AS (SELECT w.qid, coalesce(best <= 1, false)::INT::DOUBLE AS hit1, coalesce(best <= 3, false)::INT::DOUBLE AS hit3, coalesce(best <= 5, false)::INT::DOUBLE AS hit5, coalesce(best <= 10, false)::INT::DOUBLE AS hit10,
           round(coalesce(1 / best, 0), 6) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))), 0), 6) AS ndcg FROM w LEFT JOIN f ON f.qid = w.qid)"""


@query(f"WITH {BM25}, {_RELEVANT}, {_metrics('bm', 'sparse_rank')} SELECT * FROM pi")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = _bm25(spark, sf_dir).withColumnRenamed("sparse_rank", "place")
    return evaluation.ranking_metrics(_asked(spark, sf_dir), ranking, _relevant(spark, sf_dir))


_MARKED = "CASE WHEN doc_id % 2 = 0 THEN '(a) ' || text || ' (1)' ELSE '(1) ' || text END"


@query(f"""WITH {BM25}, {_RELEVANT},
    t AS (SELECT r.qid, string_agg({_MARKED}, chr(10) ORDER BY sparse_rank) AS x FROM bm r SEMI JOIN re ON re.qid = r.qid AND re.id = r.id JOIN documents d ON d.doc_id = r.id WHERE sparse_rank <= 5 GROUP BY r.qid)
    SELECT w.qid, coalesce(regexp_matches(x, '(?is)\\(\\s*a\\s*\\).*\\(\\s*1\\s*\\)'), false)::INT::DOUBLE AS subsection_evidence FROM (SELECT DISTINCT qid FROM re) w LEFT JOIN t ON t.qid = w.qid""")
def subsection_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the relevant documents among the first five hold ``(a)`` and then ``(1)``; every other document is written to."""
    items = _relevant(spark, sf_dir).groupBy("qid").agg(F.collect_set("id").alias("expected")).withColumn("markers", F.array(F.lit("a"), F.lit("1")))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("(a) "), "text", F.lit(" (1)"))).otherwise(F.concat(F.lit("(1) "), "text"))
    docs = parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_id"), text.alias("text"))
    return evaluation.subsection_evidence(items, _bm25(spark, sf_dir).withColumnRenamed("sparse_rank", "place"), docs)


#: The configurations that are compared, and the floor of the scorer's best, fitted to shares of words.
CONFIGS = tuple(evaluation.Config(*c) for c in (("bm25_only", 0.0, 0.35), ("dense_only", 0.65, 0.0), ("hybrid", 0.65, 0.35, True, False, True), ("hybrid_rerank", 0.65, 0.35, True, True, True)))
RERANK_FLOOR = 0.2


def _compared(spark, sf_dir):
    """Every configuration's ranking: both legs are found once."""
    docs, asked = parquet(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    both = saver(spark)(retrieval.fuse(_dense(spark, sf_dir), _bm25(spark, sf_dir))).withColumn("exact", F.col("qid") == F.col("id"))
    heads = retrieval.some(docs, "doc_id", both, "id").select(F.col("doc_id").alias("id"), F.lit(True).alias("held"), F.coalesce(F.substring("text", 1, 400), F.lit("")).alias("head"))
    score = T.overlap(T.content_words(F.col("text")), T.content_words(F.col("head")))
    found = both.join(heads, "id", "left").join(asked, "qid").withColumn("relevance", score).withColumn("candidate_stored", F.coalesce("held", F.lit(False)))
    return evaluation.configured(found.drop("head", "held", "text", "rrf"), CONFIGS)


def _configs(spark, sf_dir):
    """Metrics of all configurations, and how many questions without an answer each refuses and with one it answers."""
    ranking = saver(spark)(_compared(spark, sf_dir))  # read by the metrics and the guard
    relevant, docs = saver(spark)(_relevant(spark, sf_dir)), parquet(spark, sf_dir, "documents")
    asked = _asked(spark, sf_dir).withColumn("config", F.explode(F.array(*[F.lit(c.name) for c in CONFIGS])))
    per_item = evaluation.ranking_metrics(asked, ranking, relevant, by=("config",))
    first = ranking.filter("place <= 6")
    hits = first.join(retrieval.some(docs, "doc_id", first, "id").select(F.col("doc_id").alias("id"), F.substring("text", 1, 4000).alias("body")), "id")
    # six hits a question
    seen = F.flatten(F.collect_list(F.when(F.col("place") <= 3, T.content_words(F.col("body")))))
    evidence = hits.groupBy("config", "qid").agg(F.max("dense_score").alias("max_cos"), F.max("exact").alias("exact"), F.max("rerank_best").alias("rerank_best"), seen.alias("seen"))
    known = asked.join(evidence, ["config", "qid"], "left").withColumn("overlap", T.overlap(T.content_words(F.col("text")), F.coalesce("seen", F.array().cast("array<string>"))))
    said = retrieval.guard(known, Settings(guard_rerank_floor=RERANK_FLOOR)).join(relevant.select("qid", F.lit(True).alias("real")).distinct(), "qid", "left").withColumn("real", F.coalesce("real", F.lit(False)))
    rates = said.groupBy("config").agg(evaluation.rate(F.col("refused"), ~F.col("real")).alias("refusal_rate"), evaluation.rate(~F.col("refused"), F.col("real")).alias("answered_rate"), F.count(F.when(F.col("reason") == "weak_evidence", 1)).alias("weak"))
    return evaluation.macro(per_item, "config").join(rates, "config")


_AB = f"""WITH {_BOOSTED}, {_RELEVANT},
    rr AS (SELECT od.*, CASE WHEN pos <= 24 THEN {_coverage("b.text", "left(d.text, 400)")} END AS coverage FROM od JOIN documents d ON doc_id = id JOIN benchmark b ON item_id = qid),
    al AS (SELECT 'bm25_only' AS config, qid, id, sparse_rank AS place, NULL::DOUBLE AS cos, false AS exact, NULL::DOUBLE AS coverage FROM bm UNION ALL SELECT 'dense_only', qid, id, dense_rank, dense_score, false, NULL FROM dn
           UNION ALL SELECT 'hybrid', qid, id, pos, dense_score, exact, NULL FROM od
           UNION ALL SELECT 'hybrid_rerank', qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(CASE WHEN exact THEN 1e6 ELSE 0 END + coalesce(coverage, -1e9) + 10 * score, 8) DESC, pos), dense_score, exact, max(coverage) OVER (PARTITION BY qid) FROM rr),
    ce AS (SELECT config, qid, max(cos) AS max_cos, bool_or(exact) AS exact, max(coverage) AS best, flatten(list({words("left(text, 4000)")}) FILTER (WHERE place <= 3)) AS tw FROM al JOIN documents ON doc_id = id WHERE place <= 6 GROUP BY ALL),
    co AS (SELECT c.config, b.item_id AS qid, coalesce(max_cos, 0) AS max_cos, coalesce(exact, false) AS exact, best, CASE WHEN len(list_distinct({words("b.text")})) > 0 THEN len(list_intersect(list_distinct({words("b.text")}), coalesce(tw, []))) / len(list_distinct({words("b.text")})) ELSE 0.0 END AS overlap
           FROM benchmark b CROSS JOIN (SELECT DISTINCT config FROM al) c LEFT JOIN ce ON ce.qid = b.item_id AND ce.config = c.config),
    sa AS (SELECT config, qid, overlap < 0.06 AND NOT exact AS far, coalesce(best < {RERANK_FLOOR}, false) AND NOT exact AS weak, round(0.5::DOUBLE * greatest(0, max_cos) + 0.4::DOUBLE * overlap + 0.1::DOUBLE * exact::INT, 6) < 0.52 AS low, qid IN (SELECT qid FROM re) AS real FROM co),
    ra AS (SELECT config, round(avg((far OR weak OR low)::INT) FILTER (NOT real), 4) AS refusal_rate, round(avg((NOT (far OR weak OR low))::INT) FILTER (real), 4) AS answered_rate, count(*) FILTER (weak AND NOT far) AS weak FROM sa GROUP BY config),
    f AS (SELECT config, r.qid, min(place) AS best, sum(1 / log2(place + 1)) AS dcg FROM al r SEMI JOIN re ON re.qid = r.qid AND re.id = r.id WHERE place <= 10 GROUP BY ALL),
    w AS (SELECT qid, count(*) AS n FROM re GROUP BY qid),
    pi AS (SELECT c.config, w.qid, coalesce(best <= 1, false)::INT AS hit1, coalesce(best <= 3, false)::INT AS hit3, coalesce(best <= 5, false)::INT AS hit5, coalesce(best <= 10, false)::INT AS hit10,
           round(coalesce(1 / best, 0), 6) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))), 0), 6) AS ndcg
           FROM w CROSS JOIN (SELECT DISTINCT config FROM al) c LEFT JOIN f ON f.qid = w.qid AND f.config = c.config),
    ma AS (SELECT config, count(*) AS items, round(avg(hit1), 4) AS hit1, round(avg(hit3), 4) AS hit3, round(avg(hit5), 4) AS hit5, round(avg(hit10), 4) AS hit10, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM pi GROUP BY config)"""


@query(f"{_AB} SELECT *, hit1 = max(hit1) OVER () AS best_hit1, ndcg = max(ndcg) OVER () AS best_ndcg FROM ma JOIN ra USING (config)")
def ab_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.with_best(_configs(spark, sf_dir), "hit1", "ndcg")


@query(f"""{_AB} SELECT config, hit1 >= 0.5 AS hit1_ok, hit5 >= 0.88 AS hit5_ok, ndcg >= 0.72 AS ndcg_ok, coalesce(refusal_rate >= 0.85, true) AS refusal_rate_ok, coalesce(answered_rate >= 0.98, true) AS answered_rate_ok,
    hit1 >= 0.5 AND hit5 >= 0.88 AND ndcg >= 0.72 AND coalesce(refusal_rate >= 0.85, true) AND coalesce(answered_rate >= 0.98, true) AS passed FROM ma JOIN ra USING (config)""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gate(_configs(spark, sf_dir)).select("config", "hit1_ok", "hit5_ok", "ndcg_ok", "refusal_rate_ok", "answered_rate_ok", "passed")
