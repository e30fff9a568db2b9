"""The queries op1 to op13: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from functools import cache
from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import ann, bpe, chat, divergence, embdedup, langid, minhash, mixing, packing, pii, quality, repair, secrets
from quern.llm.common import Scratch, table


@cache
def _session_key() -> str:
    return token_hex(32)


def pii_key(spark: SparkSession) -> str:
    """The key of the surrogates: the session's ``spark.quern.pii.key``, or else a random one of this process, which nobody can know later."""
    return spark.conf.get("spark.quern.pii.key", None) or _session_key()


def remainder(doc_id: str, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))
    base = F.filter("found", lambda x: x["rule"] < len(secrets.BASE_RULES))
    # a lambda of two parameters would be given the place in the array as its second
    number = lambda k: F.size(F.filter("found", lambda x: x["rule"] == k)).cast("long")
    counts = [number(k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("found")).alias("spans"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    given = mixing.mix(docs, Scratch(spark, "op2"))
    return given.select("row.doc_id", "row.source", "weight", "epoch", "block", F.col("at").alias("place"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.replace(docs, Scratch(spark, "op4"), pii_key(spark))
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join("entities", ",").alias("kinds"), "text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("id", 5) != 0)
    out = quality.predict(spark, docs, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, Scratch(spark, "op6"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.link(table(spark, sf_dir, "embeddings"), Scratch(spark, "op7"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, remainder("doc_id", 3) != 1)
    out = langid.predict(spark, docs, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def transcripts(conversations: DataFrame) -> DataFrame:
    """``conv, pos, line, state, turn``: conversations written as plain transcripts.

    By a hash of the conversation, turns are marked ``User:``, ``Human:``, ``### User:``
    or ``[User]``, and in each style about one turn in six has no marker. A null turn is
    turn 0; rows that share a turn number stand in the order of a hash of role and text,
    one after the other, and rows that repeat all of it are turns of their own.
    """
    role = F.coalesce("role", F.lit("user"))
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(4))
    spoken = F.when(style == 1, F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise("System")).otherwise(F.initcap(role))
    mark = F.when(style == 2, F.concat(F.lit("### "), spoken, F.lit(": "))).when(style == 3, F.concat(F.lit("["), spoken, F.lit("] "))).otherwise(F.concat(spoken, F.lit(": ")))
    bare = F.pmod(F.xxhash64(F.lit("bare"), "conv_id", "turn"), F.lit(6)) == 0
    text = F.concat(F.when(bare, "").otherwise(mark), F.coalesce("text", F.lit("")))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00null"))
    said = conversations.select(key.alias("key"), "conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), text.alias("said"))
    # rows that repeat are counted, so that each gets places of its own
    turns = said.groupBy("key", "conv_id", "turn", "role", "said").agg(F.count("*").alias("copies")).withColumn("lines", F.split("said", "\n")).withColumn("h", F.xxhash64("role", "said"))
    # places in three steps, so that no window holds a whole transcript, nor all rows of a turn number that many rows share
    sizes = turns.groupBy("key", "turn", "h").agg(F.sum(F.col("copies") * F.size("lines")).alias("n")).withColumn("slot", F.shiftright("h", 54))
    slots = sizes.groupBy("key", "turn", "slot").agg(F.sum("n").alias("sn")).withColumn("part", F.floor(F.col("turn") / 1024))
    parts = slots.groupBy("key", "part").agg(F.sum("sn").alias("pn"))
    upto = parts.select("key", "part", (F.sum("pn").over(Window.partitionBy("key").orderBy("part")) - F.col("pn")).alias("p0"))
    placed = slots.withColumn("s0", F.sum("sn").over(Window.partitionBy("key", "part").orderBy("turn", "slot")) - F.col("sn"))
    begins = placed.join(upto, ["key", "part"]).select("key", "turn", "slot", (F.col("s0") + F.col("p0")).alias("b0"))
    inner = F.sum("n").over(Window.partitionBy("key", "turn", "slot").orderBy("h")) - F.col("n")
    before = sizes.withColumn("t0", inner).join(begins, ["key", "turn", "slot"]).select("key", "turn", "h", (F.col("t0") + F.col("b0")).alias("before"))
    each = turns.join(before, ["key", "turn", "h"]).select("conv_id", "turn", "role", "before", "lines", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
    rows = each.select("conv_id", "turn", "role", (F.col("before") + F.col("copy") * F.size("lines")).alias("before"), F.posexplode("lines").alias("k", "line"))
    number = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in chat.ROLES]), F.col("role")) - 1, F.lit(1))
    state = F.when(number < 0, 1).otherwise(number) * 2 + F.when(F.col("k") == 0, 0).otherwise(1)
    return rows.select(F.col("conv_id").alias("conv"), (F.col("before") + F.col("k")).cast("long").alias("pos"), "line", state.cast("int").alias("state"), "turn")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op9")
    lines = scratch.save(transcripts(table(spark, sf_dir, "conversations")))
    model = chat.train(lines.filter(remainder("conv", 5) != 0))
    return chat.turns(spark, lines, model).withColumnRenamed("conv", "conv_id")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_all(repair.damaged(conversations), conversations, Scratch(spark, "op11"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), Scratch(spark, "op12"))


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), Scratch(spark, "op13"), word_vocabulary())


QUERIES = {f.__name__: f for f in (op1_secrets, op2_mixing, op3_bpe, op4_pii, op5_quality, op6_neighbours, op7_embedding_dedup, op8_language, op9_chat, op10_minhash, op11_repair, op12_divergence, op13_packing)}

def _repair_sql() -> str:
    """The cheapest repair as a recursion over rows. A state is the least ``c`` (cost), ``a`` (audit) of the ways to it; ``r`` is the text that they give."""
    add = lambda v, c, s, r: f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + ({c}), 'a': {v}.a || {s}, 'r': {v}.r || {r}}} END"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    put = lambda v, who: add(v, 2, "'I'", f"chr(10) || '{who}:'")
    turn = lambda v, who: add(v, f"CASE WHEN x.i = '{who[0]}' THEN 0 ELSE 2 END + x.cut", f"CASE WHEN x.i = '{who[0]}' THEN 'K' ELSE 'R' END", f"chr(10) || CASE WHEN x.i = '{who[0]}' THEN x.role ELSE '{who}' END || ':' || x.text")
    out = lambda v: add(v, 3, "'D'", "''")
    asked, told = least("s.a", put("s.b", "user"), put("s.h", "user"), put("s.t", "user")), least("s.t", put("s.a", "assistant"))
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
    kept = lambda *xs: f"CASE WHEN x.gone THEN NULL ELSE {least(*xs)} END"
    return f"""
        WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        bits AS (SELECT k, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps FROM (SELECT DISTINCT k FROM o)),
        crc AS (SELECT k, xor(list_reduce(steps, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295::BIGINT) % 20 AS n FROM bits),
        m AS (SELECT o.conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role,
                     CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN n = 3 THEN [0, 1] ELSE [0] END) AS copy
              FROM o JOIN crc USING (k) WHERE n <> 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM m),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
                     lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || substr(role, 1, 1) AS met FROM p),
        x AS (SELECT conv_id, pos, role, text, substr(role, 1, 1) AS i, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS cut FROM f),
        w AS (SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS b, {none} AS h, {none} AS a, {none} AS t FROM (SELECT DISTINCT conv_id FROM conversations)
              UNION ALL
              SELECT s.conv_id, x.pos, {out("s.b")}, {least(out("s.h"), f"CASE WHEN NOT x.gone AND x.i = 's' THEN {add('s.b', 'x.cut', chr(39) + 'K' + chr(39), 'chr(10) || x.role || chr(58) || x.text')} END")},
                     {least(out("s.a"), kept(turn("s.b", "user"), turn("s.h", "user"), turn("s.t", "user")))}, {least(out("s.t"), kept(turn("s.a", "assistant")))}
              FROM (SELECT conv_id, pos, b, h, a, {told} AS t FROM (SELECT conv_id, pos, b, h, {asked} AS a, t FROM w s) s) s
              JOIN x ON x.conv_id IS NOT DISTINCT FROM s.conv_id AND x.pos = s.pos + 1),
        e AS (SELECT conv_id, {least("s.b", told)} AS v FROM (SELECT conv_id, pos, b, h, {asked} AS a, t FROM w s) s
              QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
        n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                     count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (met NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, v.c AS cost, v.a AS audit, sha256(substr(v.r, 2)) AS repaired_sha256
        FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLES = {
    "op11_repair": _repair_sql(),
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
        l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
        g AS (SELECT o.lang, o.source, coalesce(l.v, 0) AS v, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) o
              LEFT JOIN l ON l.lang = o.lang LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s ON s.lang = o.lang AND s.source = o.source),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v)::HUGEINT)::HUGEINT AS p
              FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        q AS (SELECT k.lang, k.term, (1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v)::HUGEINT)::HUGEINT AS q FROM k JOIN l ON l.lang = k.lang),
        s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL
              SELECT p.lang, p.source, 'term', p.term, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT
              FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
        WHERE part = 'pair' OR rank <= 10""",
    "op6_neighbours": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda x, y: x + y) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 20""",
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
        FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op10_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS s
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
        FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
