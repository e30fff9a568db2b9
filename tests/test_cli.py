"""The command line, from a regulation's file to a report."""

import json

from quern import cli

LONG = "Each employer shall keep a written record of the exposure of every employee to the substances in this table, for thirty years."
XML = f'<R><DIV5 N="1910" TYPE="PART"><DIV8 N="1910.7" TYPE="SECTION"><HEAD>§ 1910.7 Pumps.</HEAD><P>(a) Pumps are checked. {LONG}</P></DIV8><DIV8 N="1910.8" TYPE="SECTION"><HEAD>§ 1910.8 Gloves.</HEAD><P>(b) Gloves are worn. {LONG}</P></DIV8></DIV5></R>'


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "title.xml").write_text(XML)
    (tmp_path / "golden.jsonl").write_text(json.dumps({"id": "g1", "question": "pumps checked", "expected_sections": ["29 CFR 1910.7"], "expected_subsections": ["a"], "source_type": "ecfr", "adversarial": False}))
    root = str(tmp_path / "tables")

    def run(*args):
        capsys.readouterr()
        cli.main([args[0], root, *args[1:]])
        return capsys.readouterr().out

    assert json.loads(run("describe"))["status"] == "empty"
    assert json.loads(run("ingest", f"{tmp_path}/title.xml", "--date", "2026-01-02"))["sections"] == 2
    assert json.loads(run("describe"))["status"] == "not indexed" and run("index").strip() == "2" and run("index").strip() == "0"
    assert "29 CFR 1910.7" in run("search", "pumps checked")
    events = [json.loads(x) for x in run("chat", "are pumps checked").splitlines()]
    assert events[-1]["type"] == "done" and events[0]["type"] == "meta"
    assert "hybrid_rerank" in run("eval", f"{tmp_path}/golden.jsonl") and "hybrid_rerank" in run("report")
    assert "total_traces" in run("stats")
    assert json.loads(run("refresh", f"{tmp_path}/title.xml"))["embedded"] == 0 and json.loads(run("describe"))["status"] == "ready"
