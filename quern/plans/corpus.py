"""Queries on texts, citations, markup, conversations and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import citations as C
from quern.functions import text as T
from quern.operators import answers, chunking, cleaning, traces
from quern.plans.registry import query
from quern.sources import tables
from quern.sources.tables import parquet



def sentences_of(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.;:!?])\s+([A-Z(§])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


_SENTENCES = sentences_of("text")


def count_of(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'))"


_TOKENS = count_of("text")


@query(f"SELECT doc_id, unnest({_SENTENCES}) AS sentence, unnest(range(len({_SENTENCES}))) AS pos FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query(f"SELECT lang, count(*) AS docs, sum({_TOKENS})::BIGINT AS tokens FROM documents GROUP BY lang")
def token_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(T.count_tokens(F.col("text"))).cast("long").alias("tokens"))


def _sections(spark, sf_dir):
    docs = parquet(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("section_id"), "source", F.col("lang").alias("part"), cleaning.parent_path(F.col("lang"), F.col("source")).alias("parent_path"), F.substring("text", 1, 60).alias("heading"), "text", F.lit("").alias("url"))


_PIECE = "STRUCT(s VARCHAR, n BIGINT)[]"


@query(rf"""WITH d AS (SELECT doc_id, text, {_TOKENS} AS tokens, list_transform(flatten(list_transform({_SENTENCES}, lambda x: CASE WHEN {count_of("x")} > 440 THEN string_split(regexp_replace(x, '([,;])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [x] END)), lambda x: {{'s': x, 'n': {count_of("x")}}}) AS p FROM documents),
    g AS (SELECT *, list_reduce(list_prepend({{'full': []::{_PIECE}[], 'held': []::{_PIECE}, 'used': 0::BIGINT}}, list_transform(p, lambda x: {{'full': []::{_PIECE}[], 'held': [x], 'used': x.n}})),
             lambda a, x: CASE WHEN len(a.held) > 0 AND a.used + x.used > 220 THEN {{'full': list_append(a.full, a.held), 'held': x.held, 'used': x.used}} ELSE {{'full': a.full, 'held': list_concat(a.held, x.held), 'used': a.used + x.used}} END) AS r FROM d),
    w AS (SELECT doc_id, text, tokens, list_append(r.full, r.held) AS runs FROM g),
    t AS (SELECT *, list_transform(runs, lambda run: list_reduce(list_prepend({{'m': 0::BIGINT, 'used': 0::BIGINT, 'stop': false}}, list_transform(list_reverse(run), lambda x: {{'m': 1::BIGINT, 'used': x.n, 'stop': false}})),
             lambda a, x: CASE WHEN a.stop OR (a.m > 0 AND a.used + x.used > 48) THEN {{'m': a.m, 'used': a.used, 'stop': true}} ELSE {{'m': a.m + 1, 'used': a.used + x.used, 'stop': a.used + x.used >= 48}} END).m) AS tails FROM w),
    b AS (SELECT doc_id, text, CASE WHEN tokens <= 252 THEN [text] ELSE list_transform(range(1, len(runs) + 1), lambda k: array_to_string(list_transform(CASE WHEN k = 1 THEN runs[1] ELSE list_concat(list_slice(runs[k - 1], len(runs[k - 1]) - tails[k - 1] + 1, len(runs[k - 1])), runs[k]) END, lambda x: x.s), ' ')) END AS bodies FROM t)
    SELECT doc_id || '#' || k AS chunk_id, k::INTEGER AS chunk_idx, md5(doc_id || ' — ' || left(text, 60) || chr(10) || body) AS text FROM (SELECT doc_id, text, unnest(bodies) AS body, unnest(range(len(bodies))) AS k FROM b)""")
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_sections(spark, sf_dir)).select("chunk_id", "chunk_idx", F.md5("text").alias("text"))


@query("SELECT doc_id, lang || ' › ' || source AS path, left(text, 300) AS heading FROM documents WHERE length(text) >= 120 AND NOT contains(left(text, 60), '[Reserved]')")
def reject_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cleaning.without_reserved(_sections(spark, sf_dir))
    return kept.select(F.col("section_id").cast("long").alias("doc_id"), F.col("parent_path").alias("path"), F.substring("text", 1, 300).alias("heading"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
    lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:\s*\d+\s*|OSHA\s*\d{3,4}[A-Za-z0-9\- ]*|www\.osha\.gov\s*|1-800-321-OSHA.*|Occupational Safety and Health Administration\s*)$')), ' ') AS body FROM documents""")
def noise_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "documents").select("doc_id", T.without_noise_lines(F.col("text")).alias("body"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents")
def whitespace_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("body"))


@query(r"""WITH c AS (SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
        lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:\s*\d+\s*|OSHA\s*\d{3,4}[A-Za-z0-9\- ]*|www\.osha\.gov\s*|1-800-321-OSHA.*|Occupational Safety and Health Administration\s*)$')), ' ') AS t FROM conversations),
    n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS grp FROM c WHERE t <> '')
    SELECT conv_id AS doc, grp, CASE WHEN count(*) > 1 THEN 'pp. ' || min(turn) || '-' || max(turn) ELSE 'p. ' || min(turn) END AS label, string_agg(t, chr(10) ORDER BY turn) AS body FROM n GROUP BY conv_id, grp""")
def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.page_groups(parquet(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<p>(.*?)</p>')) AS paragraphs, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages""")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(?is)<p>(.*?)</p>"), F.lit(0))).cast("long").alias("paragraphs"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.html_blocks(parquet(spark, sf_dir, "pages"), "page_id", "html")


@query("""WITH n AS (SELECT doc_id, lang || '-' || source AS id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)
    SELECT doc_id, CASE WHEN n = 1 THEN id WHEN n = 2 THEN id || ' dup' ELSE id || ' dup#' || n END AS unique_id FROM n""")
def id_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "lang", "source").alias("id"))
    return cleaning.unique_ids(rows, "id", "doc_id", F.lit("dup")).select("doc_id", "unique_id")


#: Section ids in the forms that a corpus has, and texts that cite some of them; the same SQL makes them on both sides.
_WRITTEN = "CASE doc_id % 6 WHEN 0 THEN '29 CFR 1910.' || doc_id || '(b)(1)' WHEN 1 THEN '§1926.' || doc_id || '(d)(2)(ii)' WHEN 2 THEN ' 1910.' || doc_id || 'a ' WHEN 3 THEN 'OSHA ' || (3000 + doc_id) || ' (pp. 4-' || (4 + doc_id % 9) || ')' WHEN 4 THEN 'osha FS-' || upper(lang) || doc_id || ' (p. ' || doc_id % 8 || ')' ELSE ' ' || source || ' ' END"
_ALSO = "CASE doc_id % 3 WHEN 0 THEN '29 C.F.R. § 1926.' || doc_id % 7 || '(a)(1)(i)' WHEN 1 THEN 'OSHA 31' || (10 + doc_id % 50) || ' (pages ' || doc_id % 7 || '–' || (doc_id % 7 + doc_id % 3) || ')' ELSE '[OSHA FS-3529]' END"
_MIDDLE = "CAST(floor(length(text) / 2) AS INT)"
_CITING = f"substr(text, 1, {_MIDDLE}) || ' See ' || ({_WRITTEN}) || ', or ' || ({_ALSO}) || '; an OSHA question. Again [' || ({_WRITTEN}) || '] and 【29 CFR 1910.7(c)】 and § 1910.7(c). ' || substr(text, {_MIDDLE} + 1)"


def _regex(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _root(number: str) -> str:
    return f"'29 CFR ' || regexp_replace({number}, '(?:\\([0-9a-zA-Z]+\\))+$', '')"


def _written(spark, sf_dir, expression):
    return parquet(spark, sf_dir, "documents").select("doc_id", F.expr(expression).alias("cited"))


def normal(s: str) -> str:
    """What ``citations.normalise`` gives, in SQL."""
    part = lambda p: f"regexp_extract({s}, {_regex(p)}, 1)"
    has = lambda p: f"regexp_matches({s}, {_regex(p)})"
    return f"CASE WHEN {has(C.CFR)} THEN {_root(part(C.CFR))} WHEN {has(C.BARE)} THEN {_root(part(C.BARE))} WHEN {has(C.DOCUMENT)} THEN 'OSHA ' || upper({part(C.DOCUMENT)}) WHEN {has(C.NUMBER)} THEN {_root(part(C.NUMBER))} ELSE trim({s}) END"


@query(f"SELECT doc_id, {normal('s')} AS root FROM (SELECT doc_id, {_WRITTEN} AS s FROM documents)")
def citation_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, _WRITTEN).select("doc_id", C.normalise(F.col("cited")).alias("root"))


def _numbered(pattern: str) -> str:
    return f"SELECT doc_id, {_root('n')} AS root, array_to_string(regexp_extract_all(regexp_extract(n, '((?:\\([0-9a-zA-Z]+\\))*)$', 1), '\\(([0-9a-zA-Z]+)\\)', 1), ',') AS subsections, NULL::INTEGER AS page_lo, NULL::INTEGER AS page_hi FROM (SELECT doc_id, unnest(regexp_extract_all(s, {_regex(pattern)}, 1)) AS n FROM c)"


@query(f"""WITH c AS (SELECT doc_id, {_CITING} AS s FROM documents),
    p AS (SELECT doc_id, d, nullif(regexp_extract(r, {_regex(C.DOCUMENT)}, 2), '')::INTEGER AS lo, nullif(regexp_extract(r, {_regex(C.DOCUMENT)}, 3), '')::INTEGER AS hi
          FROM (SELECT doc_id, r, regexp_extract(r, {_regex(C.DOCUMENT)}, 1) AS d FROM (SELECT doc_id, unnest(regexp_extract_all(s, {_regex(C.DOCUMENT)}, 0)) AS r FROM c)) WHERE regexp_matches(d, '[0-9]') OR NOT regexp_matches(d, '[a-z]'))
    SELECT DISTINCT * FROM ({_numbered(C.CFR)} UNION ALL {_numbered(C.BARE)} UNION ALL SELECT doc_id, 'OSHA ' || upper(d), '', lo, coalesce(hi, lo) FROM p)""")
def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _written(spark, sf_dir, _CITING).select("doc_id", F.explode(C.parse(F.col("cited"))).alias("r"))
    return refs.select("doc_id", "r.root", F.array_join("r.subsections", ",").alias("subsections"), "r.page_lo", "r.page_hi")


@query(f"""WITH c AS (SELECT doc_id, {_CITING} AS s FROM documents),
    g AS (SELECT doc_id, string_split_regex(s, {_regex(C.BRACKETED.replace("(29", "(?:29"))}) AS gaps, list_transform(regexp_extract_all(s, {_regex(C.BRACKETED)}, 1), lambda x: '[' || x || '](#cite:' || replace(replace(replace(url_encode(x), '+', '%20'), '%28', '('), '%29', ')') || ')') AS links FROM c)
    SELECT doc_id, array_to_string(flatten(list_transform(range(1, len(gaps) + 1), lambda i: [gaps[i], coalesce(links[i], '')])), '') AS linked FROM g""")
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, _CITING).select("doc_id", C.linked(F.col("cited")).alias("linked"))


@query(r"SELECT doc_id, regexp_matches('x (' || lang || ') of (1) ' || text, '(?is)\(\s*' || 'en' || '\s*\).*\(\s*1\s*\)') AS chained FROM documents")
def citation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("x ("), "lang", F.lit(") of (1) "), "text")
    return parquet(spark, sf_dir, "documents").select("doc_id", C.chain_exists(text, F.array(F.lit("en"), F.lit("1"))).alias("chained"))


@query(f"""WITH p AS (SELECT doc_id, nullif(regexp_extract(s, {_regex(C.DOCUMENT)}, 2), '')::INTEGER AS lo, nullif(regexp_extract(s, {_regex(C.DOCUMENT)}, 3), '')::INTEGER AS hi FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_WRITTEN} ELSE {_ALSO} END AS s FROM documents))
    SELECT doc_id, lo, coalesce(hi, lo) AS hi, NOT (coalesce(hi, lo) < 3 OR lo > 5) AS overlaps FROM p""")
def citation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _written(spark, sf_dir, f"CASE WHEN doc_id % 2 = 0 THEN {_WRITTEN} ELSE {_ALSO} END")
    first, last = C.pages(F.col("cited"))
    return ids.select("doc_id", first.alias("lo"), last.alias("hi"), (~((last < 3) | (first > 5))).alias("overlaps"))


@query("""SELECT doc_id AS aid, CASE WHEN lang = 'es' THEN 'section_not_in_context' WHEN lang = 'de' AND NOT regexp_matches(text, '(?is)\\(\\s*b\\s*\\)') THEN 'subsection (b) not found in cited section' ELSE '' END AS reason,
    NOT (lang = 'es' OR (lang = 'de' AND NOT regexp_matches(text, '(?is)\\(\\s*b\\s*\\)'))) AS valid, '29 CFR 1910.' || doc_id AS root FROM documents""".replace("\\\\", "\\"))
def citation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    name = F.concat(F.lit("29 CFR 1910."), F.col("doc_id").cast("string"))
    written = docs.select(F.col("doc_id").alias("aid"), F.concat(F.lit("As "), name, F.when(F.col("lang") == "de", "(b)").otherwise(""), F.lit(" says.")).alias("answer"))
    packed = docs.filter("lang <> 'es'").select(F.col("doc_id").alias("aid"), name.alias("section_id"), "text")
    return answers.validate(written, packed).select("aid", "root", "valid", "reason")


@query("""SELECT count(*) AS total_traces, round(avg((event_type = 'error')::INT), 4) AS refusal_rate, NULL::DOUBLE AS avg_first_token_ms,
    round(list_sort(list(value))[least(count(*) - 1, floor(0.5 * count(*)))::BIGINT + 1], 1) AS p50_latency_ms,
    round(list_sort(list(value))[least(count(*) - 1, floor(0.95 * count(*)))::BIGINT + 1], 1) AS p95_latency_ms FROM events""")
def trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.stats(parquet(spark, sf_dir, "events"), F.col("event_type") == "error", "value")


@query("SELECT (props ->> '$.k') AS section_id, count(*) AS count FROM events WHERE (props ->> '$.k') IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def trace_top_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.array_compact(F.array(F.get_json_object("props", "$.k")))
    return traces.top_cited(parquet(spark, sf_dir, "events"), cited)


@query("SELECT event_id, ts, event_type, value FROM events ORDER BY ts DESC, event_id LIMIT 50")
def trace_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.recent(parquet(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "ts", "event_type", "value")


@query("SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def trace_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.upsert(parquet(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "ts", "value")


@query("""SELECT conv_id, turn, role, left(text, 2000) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
    WHERE n <= 4 AND role IN ('user', 'assistant') AND length(text) > 0""")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.history(parquet(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


_TALK = """(?i)^(hi|hey|hello|yo|sup|howdy|thanks|thank you|thx|ty|ok|okay|cool|nice|great|good (morning|afternoon|evening|day))(\\s+(there|everyone|everybody|all|friend|friends|team|guys|sir|ma''am|am|man))?[\\s!.,?]*$"""
_ABOUT = """(?i)\\b(who are you|what are you|what(?:''s| is) your name|what can you do|how do you work|what do you know|can you help|help me understand you)\\b"""


@query(f"""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' Hello there! ' WHEN 1 THEN 'so what can you do? ' || text WHEN 2 THEN text ELSE 'thanks, ' || text END AS q FROM conversations)
    SELECT conv_id, turn, regexp_matches(trim(q), '{_TALK}') OR regexp_matches(q, '{_ABOUT}') AS conversational FROM t""")
def conversational_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.col("turn") % 4
    q = F.when(four == 0, F.lit(" Hello there! ")).when(four == 1, F.concat(F.lit("so what can you do? "), "text")).when(four == 2, F.col("text")).otherwise(F.concat(F.lit("thanks, "), "text"))
    return parquet(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_conversational(q).alias("conversational"))


@query("SELECT doc_id, sha1(doc_id || '#0' || text) AS hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index that holds the labelled documents still has to embed."""
    docs = parquet(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("chunk_id"), "text")
    old = docs.join(parquet(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("chunk_id", F.sha1(F.concat("chunk_id", "text")).alias("hash"))
    return tables.changed(old, docs).select("doc_id", "hash")


@query("SELECT sha1(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "documents").groupBy(F.sha1("text").alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("""WITH p AS (SELECT doc_id::VARCHAR AS id, sha1(doc_id::VARCHAR || coalesce(text, '')) AS h, left(sha1(doc_id::VARCHAR), 3) AS part FROM documents),
    i AS (SELECT part, sha1(string_agg(h, '' ORDER BY id, h)) AS h, count(*) AS n FROM p GROUP BY part)
    SELECT 'corpus-' || left(sha1(string_agg(h, '' ORDER BY part)), 8) AS version, sum(n)::BIGINT AS n_sections FROM i""")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.corpus_manifest(_sections(spark, sf_dir), "corpus")


@query(f"""SELECT lang AS part, count(*) AS sections, count(*) AS chunks, sum({_TOKENS})::BIGINT AS tokens FROM documents GROUP BY lang""")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = _sections(spark, sf_dir)
    return tables.ingest_stats(sections, sections, T.count_tokens)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def trace_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.streaming.traces import windowed_stats

    return windowed_stats(parquet(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
