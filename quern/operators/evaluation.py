"""Ranking metrics, A/B configurations and the regression gate."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions import citations as C
from quern.functions import text as T

METRICS = ("hit1", "hit3", "hit5", "hit10", "mrr", "ndcg")


def ranking_metrics(items: DataFrame, ranking: DataFrame, relevant: DataFrame, depth: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """``qid`` and METRICS of every item that has something relevant; with ``by``, for each of their values that ``items`` has.

    ``ranking (qid, id, place)`` is cut to ``depth`` after repeated ids are dropped;
    ``relevant (qid, id)``. Gains are binary; the ideal has as many as are relevant.
    """
    first = ranking.groupBy(*by, "qid", "id").agg(F.min("place").alias("place"))
    placed = first.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "qid").orderBy("place", "id"))).filter(F.col("rank") <= depth)
    found = placed.join(relevant.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy(*by, "qid").agg(F.min("rank").alias("best"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    want = relevant.distinct().groupBy("qid").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(depth)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    joined = items.select(*by, "qid").join(want, "qid").join(found, [*by, "qid"], "left")
    hit = lambda k: F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0)).alias(f"hit{k}")
    return joined.select(*by, "qid", hit(1), hit(3), hit(5), hit(10), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"))


def macro(per_item: DataFrame, *keys: str) -> DataFrame:
    return per_item.groupBy(*keys).agg(F.count("*").alias("items"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS])


@dataclass(frozen=True)
class Config:
    """A configuration that is compared: the weights of the legs (0: without), and whether cited sections are moved up, the pool is scored again, and only what the store holds counts."""

    name: str
    dense: float
    sparse: float
    boost: bool = False
    rerank: bool = False
    stored: bool = False


def configured(candidates: DataFrame, configs: tuple[Config, ...], s: Settings = Settings()) -> DataFrame:
    """``config, qid, id, place`` and the scores that the configuration sees, all configurations in one plan.

    ``candidates (qid, id, dense_score, dense_rank, sparse_score, sparse_rank, exact, candidate_stored, relevance)`` are both
    legs' rows, found once; each is taken up by every configuration that has its leg. ``relevance``
    is the scorer's; only the first ``rerank_top_n`` of a configuration that scores again have it.
    """
    rows = F.array(*[F.struct(*[F.lit(getattr(c, f.name)).alias(f.name) for f in fields(Config)]) for c in configs])
    each = candidates.withColumn("c", F.explode(rows)).select("*", "c.*").drop("c").withColumnRenamed("name", "config")
    seen = lambda weight, c: F.when(F.col(weight) > 0, F.col(c))
    each = each.withColumns({"dense_score": seen("dense", "dense_score"), "dense_rank": seen("dense", "dense_rank"), "sparse_score": seen("sparse", "sparse_score"), "sparse_rank": seen("sparse", "sparse_rank"), "exact": F.col("exact") & F.col("boost")})
    each = each.filter((F.col("dense_rank").isNotNull() | F.col("sparse_rank").isNotNull()) & (F.col("candidate_stored") | ~F.col("stored")))
    part = lambda weight, rank: F.coalesce(F.col(weight) / (s.rrf_k + F.col(rank)), F.lit(0.0))
    score = part("dense", "dense_rank") + part("sparse", "sparse_rank") + F.when(F.col("exact"), 1.0).otherwise(0.0)
    own = Window.partitionBy("config", "qid")
    ordered = each.withColumn("rrf", score).withColumn("pos", F.row_number().over(own.orderBy(F.desc(F.round("rrf", 10)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "id")))
    scored = ordered.withColumn("rerank_score", F.when(F.col("rerank") & (F.col("pos") <= max(s.rerank_top_n, s.final_top_k)), F.col("relevance")))
    again = F.when(F.col("exact"), 1e6).otherwise(0.0) + F.coalesce("rerank_score", F.lit(-1e9)) + 10 * F.col("rrf")
    # without scores the first order stays
    key = F.when(F.col("rerank"), F.round(again, 8)).otherwise(F.lit(0.0))
    placed = scored.withColumn("place", F.row_number().over(own.orderBy(F.desc(key), "pos"))).withColumn("rerank_best", F.max("rerank_score").over(own))
    return placed.select("config", "qid", "id", "place", "dense_score", "sparse_score", "exact", "rerank_score", "rerank_best")


def rate(flag: Column, among: Column) -> Column:
    """Share of rows with the flag among some; null if there are none."""
    return F.round(F.avg(F.when(among, flag.cast("int"))), 4)


def with_best(report: DataFrame, *metrics: str) -> DataFrame:
    everywhere = Window.partitionBy(F.lit(1))  # a row for each configuration
    return report.select("*", *[(F.col(m) == F.max(m).over(everywhere)).alias(f"best_{m}") for m in metrics])


def gate(report: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Whether each floor holds, and all; a rate that is null holds."""
    floors = {"hit1": s.eval_hit1_floor, "hit5": s.eval_hit5_floor, "ndcg": s.eval_ndcg_floor, "refusal_rate": s.eval_adversarial_refusal_floor, "answered_rate": s.eval_answered_floor}
    tests = {m: F.coalesce(F.col(m) >= f, F.lit(True)) for m, f in floors.items() if m in report.columns}
    both = None
    for test in tests.values():
        both = test if both is None else both & test
    return report.select("*", *[t.alias(f"{m}_ok") for m, t in tests.items()], both.alias("passed"))


def subsection_evidence(items: DataFrame, ranking: DataFrame, sections: DataFrame, depth: int = 5) -> DataFrame:
    """``qid, subsection_evidence``: 1 if the expected sections among the first ``depth`` hold the markers one after the other.

    ``items (qid, expected array<string>, markers array<string>)``, ``ranking (qid, id,
    place)`` and ``expected`` with roots, ``sections (section_id, text)``. The ranking is
    cut before repeats are dropped; texts are joined in its order. Items without markers
    have no row.
    """
    asked = items.filter(F.size("markers") > 0).select("qid", "expected", "markers")
    top = ranking.filter(F.col("place") <= depth).groupBy("qid", "id").agg(F.min("place").alias("place"))
    wanted = top.join(asked.select("qid", F.explode("expected").alias("id")).distinct(), ["qid", "id"], "left_semi")
    # at most ``depth`` texts an item
    texts = wanted.join(sections.select(F.col("section_id").alias("id"), "text"), "id").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"))
    found = (F.length("text") > 0) & C.chain_exists(F.col("text"), F.col("markers"))
    return asked.join(texts, "qid", "left").select("qid", F.coalesce(found, F.lit(False)).cast("double").alias("subsection_evidence"))


def answer_metrics(validated: DataFrame) -> DataFrame:
    """Citation precision and rate, and hallucinations, from ``n_cited, n_valid, n_hallucinated``.

    With ``answer_vec, context_vec, question_vec`` also groundedness and relevance: the
    answer's cosine with the context and with the question.
    """
    cited = F.col("n_cited") > 0
    out = validated.select("*", F.round(F.when(cited, F.col("n_valid") / F.col("n_cited")).otherwise(0.0), 4).alias("citation_precision"), F.when(cited, 1.0).otherwise(0.0).alias("citation_rate"), F.col("n_hallucinated").cast("double").alias("hallucinated_citations"))
    if "answer_vec" not in validated.columns:
        return out
    near = lambda other: F.round(T.cosine(F.col("answer_vec"), F.col(other)), 4)
    return out.withColumn("groundedness", near("context_vec")).withColumn("relevance", near("question_vec"))


def _table(names: list[str], rows: list[list]) -> list[str]:
    shown = lambda x: "-" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    line = lambda cells: "| " + " | ".join(map(shown, cells)) + " |"
    return [line(names), line(["---"] * len(names)), *map(line, rows), ""]


ANSWERS = ("citation_precision", "citation_rate", "hallucinated_citations", "groundedness", "relevance")
RATES = ("subsection_evidence", "answered_rate", "refusal_rate")


def render(report: dict) -> str:
    """A stored report, ``{created_at, runs, items}`` as ``Engine.evaluate`` leaves it, in Markdown: a table of rankings and rates, one of answers if there are any, and the items of the last configuration."""
    runs, items = report.get("runs", []), report.get("items", [])
    out = ["# Evaluation", "", f"Made at {report.get('created_at', 'unknown')}; {len(runs)} configurations.", "", "## Retrieval", ""]
    out += _table(["config", *METRICS, *RATES, "passed"], [[r["config"], *(r.get(m) for m in (*METRICS, *RATES)), r.get("passed")] for r in runs])
    answered = [r for r in runs if r.get("citation_rate") is not None]
    if answered:
        out += ["## Answers", "", *_table(["config", *ANSWERS], [[r["config"], *(r.get(m) for m in ANSWERS)] for r in answered])]
    if items:
        last = [i for i in items if i["config"] == items[-1]["config"]]
        out += [f"## Items of {last[0]['config']}", "", *_table(["id", "adversarial", "refused", "reason", "grounding", "hit5", "mrr", "first"], [[i["id"], i["adversarial"], i["refused"], i["reason"], i["grounding"], i["hit5"], i["mrr"], i["first"]] for i in last])]
    return "\n".join(out)
