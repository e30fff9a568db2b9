"""Queries on answers, cited sections, hits and what is shown of them. Their SQL is built on that of the queries before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import citations as C
from quern.functions import text as T
from quern.operators import answers, cleaning, evaluation, retrieval, traces
from quern.plans import corpus
from quern.plans import retrieval as found
from quern.plans.registry import ORACLES, query
from quern.sources.tables import parquet


@query(f"""WITH n AS ({ORACLES["citation_normalise"]}), g AS (SELECT doc_id, list(DISTINCT root) AS cited FROM ({ORACLES["citation_parse"]}) GROUP BY doc_id)
    SELECT doc_id, coalesce(len(cited), 0)::INTEGER AS roots, CASE WHEN list_contains(cited, root) THEN starts_with(root, '29 CFR 1910.') END AS valid FROM n LEFT JOIN g USING (doc_id)""")
def citation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sections a text cites, and whether a given one is cited and valid (those of part 1910 are), cited and not, or not cited (null)."""
    docs = parquet(spark, sf_dir, "documents").select("doc_id", C.normalise(F.expr(corpus._WRITTEN)).alias("root"), C.roots(F.expr(corpus._CITING)).alias("cited"))
    valid = F.filter("cited", lambda r: r.startswith("29 CFR 1910."))
    return docs.select("doc_id", F.size("cited").alias("roots"), C.status(F.col("root"), F.col("cited"), valid).alias("valid"))


#: Sources of an answer, what is selected and opened among them, a label and the labels known as invalid.
_SOURCES = ("'29 CFR 1910.' || doc_id || '(c)'", "'OSHA 31' || (10 + doc_id % 50) || ' (p. 1)'", "source")
_LABEL = "CASE doc_id % 2 WHEN 0 THEN '  osha   FS-' || lang || ' ' ELSE upper(source) || '  x' END"


def _having(one: str) -> str:
    return f"list_filter([{', '.join(_SOURCES)}], lambda x: {corpus.normal('x')} = {corpus.normal(one)})[1]"


@query(f"""WITH d AS (SELECT *, {corpus._WRITTEN} AS selected, {corpus._ALSO} AS opened FROM documents)
    SELECT doc_id, coalesce({_having("selected")}, {_having("opened")}, {_SOURCES[0]}) AS shown,
    list_contains(['osha fs-' || lang, lower(source)], lower(trim(regexp_replace({_LABEL}, '\\s+', ' ', 'g')))) AS invalid FROM d""")
def citation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source that is shown for a selected or opened citation, and whether a label is among the invalid ones."""
    docs = parquet(spark, sf_dir, "documents").select("doc_id", F.array(*[F.struct(F.expr(s).alias("section_id")) for s in _SOURCES]).alias("sources"), F.expr(corpus._WRITTEN).alias("selected"), F.expr(corpus._ALSO).alias("opened"), F.expr(_LABEL).alias("label"), F.array(F.concat(F.lit("OSHA fs-"), "lang"), F.col("source")).alias("known"))
    return docs.select("doc_id", C.source_for(F.col("sources"), F.col("selected"), F.col("opened"))["section_id"].alias("shown"), C.is_invalid(F.col("label"), F.col("known")).alias("invalid"))


_SECTION = "CASE doc_id % 3 WHEN 0 THEN '29 CFR 1910.' || doc_id WHEN 1 THEN 'OSHA 31' || (10 + doc_id % 50) || ' (pp. 1-' || (1 + doc_id % 9) || ')' ELSE 'OSHA FS-3529 (p. ' || doc_id % 5 || ')' END"


@query(f"""WITH r AS (SELECT DISTINCT doc_id AS qid, root FROM ({ORACLES["citation_parse"]})), s AS (SELECT DISTINCT {_SECTION} AS section FROM documents)
    SELECT DISTINCT qid, section FROM r JOIN s ON section = root OR starts_with(section, root || ' ')""")
def cited_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that a question cites, by their id or its beginning: an equi-join on the beginnings."""
    docs = parquet(spark, sf_dir, "documents")
    asked = docs.select(F.col("doc_id").alias("qid"), F.expr(corpus._CITING).alias("text"))
    return retrieval.cited_sections(asked, docs.select(F.expr(_SECTION).alias("section_id")).distinct())


@query(f"""WITH {found._BOOSTED}, sc AS (SELECT od.*, d.text, d.source, CASE WHEN pos <= 24 THEN {found._coverage("b.text", "left(d.text, 400)")} END AS coverage FROM od JOIN documents d ON doc_id = id JOIN benchmark b ON item_id = qid),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(CASE WHEN exact THEN 1e6 ELSE 0 END + coalesce(coverage, -1e9) + 10 * score, 8) DESC, pos) AS rank, max(coverage) OVER (PARTITION BY qid) AS best FROM sc)
    SELECT qid, id, rank, source, round(coalesce(coverage, score * 10), 4) AS final_score, round(best, 4) AS rerank_best, left(text, 1600) AS excerpt FROM r WHERE rank <= 6""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six hits of each question after the rerank, with their final score and the pool's best."""
    docs = parquet(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text", F.substring("text", 1, 400).alias("head"))
    asked = found._asked(spark, sf_dir).withColumnRenamed("text", "query")
    scored = retrieval.rerank(found._ordered(spark, sf_dir).join(docs.drop("text"), "id").join(asked, "qid"), T.overlap(T.content_words(F.col("query")), T.content_words(F.col("head"))), 24)
    hits = scored.withColumn("rerank_best", retrieval.pool_best()).filter("pos <= 6")
    whole = retrieval.with_parents(hits, docs, "id", "text")
    return whole.select("qid", "id", F.col("pos").alias("rank"), "source", retrieval.final_score().alias("final_score"), F.round("rerank_best", 4).alias("rerank_best"), "excerpt")


@query(f"""SELECT qid, id, round(1 / (1 + exp(-sparse_score)), 6) AS shown, round(greatest(0.02, least(1.0, sparse_score / greatest(max(sparse_score) OVER (PARTITION BY qid), 1))), 6) AS bar FROM ({ORACLES["bm25_topk"]})""")
def score_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as a share of one and as a bar up to the question's best score."""
    top = F.greatest(F.max("sparse_score").over(retrieval.Window.partitionBy("qid")), F.lit(1.0))
    return found._bm25(spark, sf_dir).select("qid", "id", F.round(T.sigmoid(F.col("sparse_score")), 6).alias("shown"), F.round(T.score_bar(F.col("sparse_score"), F.lit(0.0), top), 6).alias("bar"))


@query(f"""SELECT round(avg(refused::INT) FILTER (WHERE qid % 4 = 0), 4) AS refusal_rate, round(avg((NOT refused)::INT) FILTER (WHERE qid % 4 <> 0), 4) AS answered_rate FROM ({ORACLES["grounding_refusal"]})""")
def refusal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of adversarial items (every fourth) that are refused, and of the others that are answered."""
    said = retrieval.guard(found._evidence(spark, sf_dir))
    adversarial = F.col("qid") % 4 == 0
    return said.agg(evaluation.rate(F.col("refused"), adversarial).alias("refusal_rate"), evaluation.rate(~F.col("refused"), ~adversarial).alias("answered_rate"))


_COS = "round(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})) + 1e-9), 4) + 0.0"


@query(f"""WITH v AS (SELECT aid, valid, lang = 'fr' AS silent FROM ({ORACLES["citation_validate"]}) JOIN documents ON doc_id = aid),
    n AS (SELECT aid, CASE WHEN silent THEN 0 ELSE 2 END AS n, CASE WHEN silent THEN 0 ELSE valid::INT END AS ok FROM v)
    SELECT aid, CASE WHEN n > 0 THEN round(ok / n, 4) ELSE 0.0 END AS citation_precision, (n > 0)::INT::DOUBLE AS citation_rate, (n - ok)::DOUBLE AS hallucinated_citations,
    {_COS.format("a.embedding::DOUBLE[]", "b.embedding::DOUBLE[]")} AS groundedness, {_COS.format("a.embedding::DOUBLE[]", "c.embedding::DOUBLE[]")} AS relevance
    FROM n JOIN embeddings a ON a.vec_id = aid JOIN embeddings b ON b.vec_id = aid + 1 JOIN embeddings c ON c.vec_id = aid + 2""")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite a section and an absent publication, or nothing; the vectors of the next two documents are those of context and question."""
    docs, vectors = parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("29 CFR 1910."), F.col("doc_id").cast("string"))
    cites = F.concat(F.lit("As "), name, F.when(F.col("lang") == "de", "(b)").otherwise(""), F.lit(" says, and OSHA 3151."))
    written = docs.select(F.col("doc_id").alias("aid"), F.when(F.col("lang") == "fr", F.lit("Nothing is cited.")).otherwise(cites).alias("answer"))
    packed = docs.filter("lang <> 'es'").select(F.col("doc_id").alias("aid"), name.alias("section_id"), "text")
    counted = written.select("aid").join(answers.summary(answers.validate(written, packed)), "aid", "left").fillna(0, ["n_cited", "n_valid", "n_hallucinated"])
    for back, column in enumerate(("answer_vec", "context_vec", "question_vec")):
        counted = counted.join(vectors.select((F.col("vec_id") - back).alias("aid"), F.col("embedding").alias(column)), "aid")
    return evaluation.answer_metrics(counted).select("aid", *evaluation.ANSWERS)


_KINDS = "CASE conv_id % 2 WHEN 0 THEN 'fact' ELSE 'booklet' END"


@query(f"""WITH g AS ({ORACLES["page_groups"]}), m AS (SELECT DISTINCT conv_id AS doc, {_KINDS} AS kind FROM conversations)
    SELECT 'OSHA ' || doc || ' (' || label || ')' AS section_id, 'osha_pdf' AS source, 'OSHA-' || upper(kind) AS part, 'OSHA Publications › ' || 'Title ' || doc AS parent_path, md5(body) AS text FROM g JOIN m USING (doc)
    UNION ALL SELECT doc_id::VARCHAR, source, lang, lang || ' › ' || source, md5(text) FROM documents""")
def corpora_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corpora as one: conversations taken as the pages of publications, and documents."""
    turns = parquet(spark, sf_dir, "conversations").withColumn("slug", F.concat(F.lit("OSHA"), F.col("conv_id").cast("string")))
    manifest = turns.select("slug", F.concat(F.lit("Title "), F.col("conv_id").cast("string")).alias("title"), F.lit("").alias("url"), F.expr(_KINDS).alias("kind")).distinct()
    both = cleaning.publication_sections(turns.select("slug", F.col("turn").alias("page"), "text"), manifest).unionByName(corpus._sections(spark, sf_dir))
    return both.select("section_id", "source", "part", "parent_path", F.md5("text").alias("text"))


@query(r"""SELECT doc_id, coalesce(TRY_CAST(regexp_extract((1850 + doc_id)::VARCHAR || lang, '^\d+') AS INTEGER) BETWEEN 1900 AND 2099, false) AS kept FROM documents""")
def part_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts are in the range that is ingested."""
    number = F.concat((F.col("doc_id") + 1850).cast("string"), "lang")
    return parquet(spark, sf_dir, "documents").select("doc_id", cleaning.in_parts(number).alias("kept"))


_HELD = ("(1 + doc_id % 5)", "(3 + doc_id % 5)")
_ASKED = ("(doc_id % 11)", "(doc_id % 11 + doc_id % 3)")


@query(f"""WITH d AS (SELECT doc_id, {_HELD[0]} AS lo, {_HELD[1]} AS hi, {_ASKED[0]} AS a, {_ASKED[1]} AS b FROM documents)
    SELECT doc_id AS aid, 'OSHA 3151' AS root, CASE WHEN b < lo OR a > hi THEN 'cited pages ' || a || '-' || b || ' not in context' ELSE '' END AS reason, NOT (b < lo OR a > hi) AS valid FROM d""")
def citation_page_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite pages of a publication, of which the context holds some."""
    docs = parquet(spark, sf_dir, "documents")
    page = lambda e: F.expr(e).cast("string")
    written = docs.select(F.col("doc_id").alias("aid"), F.concat(F.lit("See OSHA 3151 (pp. "), page(_ASKED[0]), F.lit("-"), page(_ASKED[1]), F.lit(").")).alias("answer"))
    packed = docs.select(F.col("doc_id").alias("aid"), F.concat(F.lit("OSHA 3151 (pp. "), page(_HELD[0]), F.lit("-"), page(_HELD[1]), F.lit(")")).alias("section_id"), "text")
    return answers.validate(written, packed).select("aid", "root", "reason", "valid")


@query("""SELECT count(*) AS total_traces, round(avg((event_type = 'error')::INT), 4) AS refusal_rate, round(avg(CASE WHEN event_type <> 'error' THEN value / 4 END), 1) AS avg_first_token_ms,
    round(list_sort(list(value))[least(count(*) - 1, floor(0.5 * count(*)))::BIGINT + 1], 1) AS p50_latency_ms,
    round(list_sort(list(value))[least(count(*) - 1, floor(0.95 * count(*)))::BIGINT + 1], 1) AS p95_latency_ms FROM events""")
def trace_first_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of traces in which refused questions have no first token."""
    refused = F.col("event_type") == "error"
    return traces.stats(parquet(spark, sf_dir, "events"), refused, "value", F.when(~refused, F.col("value") / 4))
