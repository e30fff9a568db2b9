"""Regulation files read in parts give what a parser of whole files gives."""

import random

from quern.operators import cleaning
from quern.sources import markup

LONG = "Each employer shall keep a written record of the exposure of every employee to the substances in this table, for thirty years."


def generated(seed, parts=3):
    """A regulation with groups, appendices inside and outside of sections, tables, skipped markup and repeated numbers."""
    r = random.Random(seed)
    out = ['<?xml version="1.0"?>\n<ROOT xml:lang="en"><!-- a > b -->']
    p = lambda: f"<P>One <I>two &amp; {r.randint(0, 99)}</I>\n {LONG}</P>"
    table = lambda: "<GPOTABLE><ROWS><TR><TH>a</TH><TD/><TD> b <P>in</P></TD></TR></ROWS><P>held</P></GPOTABLE>"
    skipped = lambda: r.choice(["<CITA>no</CITA>", "<FPNOTE><P>no</P></FPNOTE>", "<EDNOTE><GPOTABLE><TR><TD>no</TD></TR></GPOTABLE></EDNOTE>", "<X><FP>deep</FP></X>", "<PSPACE/>"])

    def inside():
        return "".join(r.choice([p, p, table, skipped])() for _ in range(r.randint(0, 5)))

    def appendix():
        return f'<DIV9 TYPE="{r.choice(["APPENDIX", "APPENDIX", "OTHER"])}" N=\'{r.choice("AB&<").replace("&", "&amp;").replace("<", "&lt;")}\'><HEAD>App {r.randint(1, 3)}</HEAD>{inside()}</DIV9>'

    def section():
        n = r.randint(1, 12)
        return f'<DIV8 N="1910.{n}" TYPE="SECTION"><HEAD>{r.choice(["", f"§ 1910.{n} "])}{r.choice(["Air.", "[Reserved]", ""])}</HEAD>{inside()}{appendix() if r.random() < 0.4 else ""}{inside()}</DIV8 >\n'

    for k in range(parts):
        out.append(f'<DIV5 N="{r.choice(["1910", "1926.a", "40"])}" TYPE="PART"><HEAD>P{k}</HEAD>{section()}')
        for _ in range(r.randint(1, 3)):
            out.append(f'<DIV6 N=" {r.choice("AB")} " TYPE="SUBPART">{r.choice(["<HEAD>Subpart—Q</HEAD>", ""])}{inside()}{section()}')
            out.append(f'<DIV7 TYPE="SUBJGRP"><HEAD>Group {k}</HEAD>{section()}{section()}</DIV7>{section()}{appendix()}</DIV6>')
        out.append("</DIV5>")
    return "".join(out) + "</ROOT>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r))


def test_files_in_parts_equal_whole_files(spark, tmp_path):
    for seed in range(4):
        (tmp_path / f"{seed}.xml").write_text(generated(seed, parts=2 + 10 * seed))
    (tmp_path / "none.xml").write_text("<ROOT/>")
    (tmp_path / "not.txt").write_text("<DIV8>")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(str(tmp_path))
    want = rows(cleaning.parse_xml(files))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        held = markup.pieces(spark, str(tmp_path))
        assert held.filter("path like '%3.xml'").select("split").distinct().count() > 5
        got = rows(cleaning.name_units(markup.units(spark, str(tmp_path)), markup.ORDER))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and len(want) > 50


def test_ids_stay_unique_whatever_repeats(spark):
    xml = f'<R><DIV5 N="1910" TYPE="PART"><DIV8 N="1910.7" TYPE="SECTION"><HEAD>A</HEAD><P>{LONG}</P></DIV8></DIV5></R>'.encode()
    files = spark.createDataFrame([(f"{k}.xml", bytearray(xml)) for k in range(4)], "path string, content binary")
    ids = [r.section_id for r in cleaning.parse_xml(files).collect()]
    assert sorted(ids) == ["29 CFR 1910.7", "29 CFR 1910.7 (29 CFR 1910)", "29 CFR 1910.7 (29 CFR 1910)#2", "29 CFR 1910.7 (29 CFR 1910)#3"]
