"""``python -m quern.cli ingest|index|refresh|search|chat|eval|report|stats|describe ROOT [ARG]``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from quern import obs
from quern.config import Settings
from quern.engine import Engine
from quern.operators import cleaning
from quern.sources import markup, tables


def _corpus(spark: SparkSession, path: str) -> DataFrame:
    return cleaning.name_units(markup.units(spark, path), markup.ORDER) if path.endswith(".xml") else tables.sections(spark, path)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["ingest", "index", "refresh", "search", "chat", "eval", "report", "stats", "describe"])
    parser.add_argument("root")
    parser.add_argument("arg", nargs="?", help="ingest, refresh: sections as JSON lines, or a regulation's XML (*.xml); search, chat: a question; eval: golden items")
    parser.add_argument("--with-answers", action="store_true")
    parser.add_argument("--date", default="unknown", help="ingest, refresh: the issue date of the corpus")
    args = parser.parse_args(argv)
    obs.to_stderr()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, args.root, Settings.from_env())
    if args.command == "ingest":
        print(json.dumps(engine.ingest(_corpus(spark, args.arg), date=args.date)))
    elif args.command == "refresh":
        print(json.dumps(engine.refresh(_corpus(spark, args.arg), date=args.date)))
    elif args.command == "index":
        print(engine.build_index())
    elif args.command == "search":
        engine.search(spark.createDataFrame([(1, args.arg)], "qid long, text string")).orderBy("rank").select("rank", "section", "final_score", "excerpt").show(truncate=100)
    elif args.command == "chat":
        for event in engine.chat(args.arg):
            print(json.dumps(event, default=str))
    elif args.command == "eval":
        engine.evaluate(tables.golden(spark, args.arg), with_answers=args.with_answers)
        print(engine.report())
    elif args.command == "report":
        print(engine.report())
    elif args.command == "describe":
        print(json.dumps(engine.describe(), default=str))
    else:
        engine.trace_stats().show()


if __name__ == "__main__":
    main()
