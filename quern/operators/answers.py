"""Validation of citations against the packed context, prompts and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import citations as C


def validate(answers: DataFrame, context: DataFrame) -> DataFrame:
    """``aid, pos, root, subsections, valid, reason`` for each citation of ``answers (aid, answer)``.

    ``context (aid, section_id, text)`` holds what the answer's prompt packed; a null
    text checks the section alone. Joined by (answer, root).
    """
    refs = answers.select("aid", F.posexplode(C.parse(F.col("answer"))).alias("pos", "ref"))
    lo, hi = C.pages(F.col("section_id"))
    packed = context.select("aid", C.normalise(F.col("section_id")).alias("root"), "section_id", "text", lo.alias("lo"), hi.alias("hi"))
    grouped = packed.groupBy("aid", "root").agg(F.array_sort(F.collect_list(F.struct("section_id", "text", "lo", "hi"))).alias("held"))
    both = refs.select("aid", "pos", "ref", F.col("ref.root").alias("root")).join(grouped, ["aid", "root"], "left")
    text = F.array_join(F.transform("held", lambda h: F.coalesce(h["text"], F.lit(""))), "\n")
    checked = F.exists("held", lambda h: h["text"].isNotNull())
    subs = F.col("ref.subsections")
    chain = F.concat(F.lit("("), F.array_join(subs, ")("), F.lit(")"))
    overlap = F.exists("held", lambda h: F.coalesce(~((F.col("ref.page_hi") < h["lo"]) | (F.col("ref.page_lo") > h["hi"])), F.lit(False)))
    reason = (
        F.when(F.col("held").isNull(), F.lit("section_not_in_context"))
        .when(checked & (F.size(subs) > 0), F.when(~C.chain_exists(text, subs), F.concat(F.lit("subsection "), chain, F.lit(" not found in cited section"))))
        .when(checked & F.col("ref.page_lo").isNotNull() & (F.col("ref.doc") != ""), F.when(~overlap, F.concat(F.lit("cited pages "), F.col("ref.page_lo"), F.lit("-"), F.col("ref.page_hi"), F.lit(" not in context"))))
    )
    return both.select("aid", "pos", F.col("ref.raw").alias("citation"), "root", subs.alias("subsections"), reason.isNull().alias("valid"), F.coalesce(reason, F.lit("")).alias("reason"))


def summary(validated: DataFrame) -> DataFrame:
    """``aid, n_cited, n_valid, n_hallucinated``: distinct roots; one can be valid and hallucinated."""
    return validated.groupBy("aid").agg(F.count_distinct("root").alias("n_cited"), F.count_distinct(F.when(F.col("valid"), F.col("root"))).alias("n_valid"), F.count_distinct(F.when(~F.col("valid"), F.col("root"))).alias("n_hallucinated"))


def history(turns: DataFrame, conv: str, turn: str, role: str, content: str, last: int = 4) -> DataFrame:
    """The last ``last`` turns of each conversation, of which those of user and assistant with content are kept, cut to 2,000 characters."""
    place = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    return turns.withColumn("_n", place).filter(F.col("_n") <= last).filter(F.col(role).isin("user", "assistant") & (F.length(content) > 0)).select(conv, turn, role, F.substring(content, 1, 2000).alias("content"))


def messages(asked: DataFrame, system: str) -> DataFrame:
    """``qid, messages``: the system prompt with the fenced context, the history and the question of ``asked (qid, query, context, history)``."""
    fenced = F.when(F.length("context") > 0, F.concat(F.lit(system), F.lit("<<<SOURCE_DATA\n"), F.col("context"), F.lit("\nSOURCE_DATA>>>"))).otherwise(F.lit(system))
    message = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    past = F.filter(F.slice("history", F.greatest(F.size("history") - 3, F.lit(1)), 4), lambda h: h["role"].isin("user", "assistant") & (F.length(h["content"]) > 0))
    past = F.transform(past, lambda h: F.struct(h["role"].alias("role"), F.substring(h["content"], 1, 2000).alias("content")))
    return asked.select("qid", F.concat(F.array(message("system", fenced)), F.coalesce(past, F.array().cast("array<struct<role:string,content:string>>")), F.array(message("user", F.col("query")))).alias("messages"))
