"""Citations of regulations and publications: parsing, normal form, validation. All columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of a citation.
CFR = r"(?i)\b29\s*(?:CFR|C\.F\.R\.)?\s*§?\s*(\d{4}\.\d+[a-z0-9]*(?:\([0-9a-zA-Z]+\))*)"
BARE = r"§\s*(\d{4}\.\d+[a-z0-9]*(?:\([0-9a-zA-Z]+\))*)"
NUMBER = r"^\s*(\d{4}\.\d+[a-z0-9]*(?:\([0-9a-zA-Z]+\))*)\s*$"
DOCUMENT = r"(?i)\bOSHA[- ]([A-Z0-9\-]{2,20})\s*(?:\((?:pp?\.|pages?)\s*(\d+)\s*(?:[-–]\s*(\d+))?\))?"
BRACKETED = r"[\[【](29\s*CFR\s*§?\s*[\d.]+(?:\([0-9a-zA-Z]+\))*|OSHA\s*[A-Z0-9-]{2,20}(?:\s*\((?:pp?\.|pages?)\s*[\d–-]+\))?)[\]】]"
REF = "array<struct<raw:string,root:string,subsections:array<string>,doc:string,page_lo:int,page_hi:int>>"


def body(number: Column) -> Column:
    """The number without its trailing markers."""
    return F.regexp_replace(number, r"(?:\([0-9a-zA-Z]+\))+$", "")


def subsections(number: Column) -> Column:
    tail = F.regexp_extract(number, r"((?:\([0-9a-zA-Z]+\))*)$", 1)
    return F.regexp_extract_all(tail, F.lit(r"\(([0-9a-zA-Z]+)\)"), F.lit(1))


def normalise(section_id: Column) -> Column:
    """The root of a section id: CFR, then section sign, publication, bare number; else the trimmed id."""
    cfr = lambda p: F.concat(F.lit("29 CFR "), body(F.regexp_extract(section_id, p, 1)))
    return (
        F.when(section_id.rlike(CFR), cfr(CFR))
        .when(section_id.rlike(BARE), cfr(BARE))
        .when(section_id.rlike(DOCUMENT), F.concat(F.lit("OSHA "), F.upper(F.regexp_extract(section_id, DOCUMENT, 1))))
        .when(section_id.rlike(NUMBER), cfr(NUMBER))
        .otherwise(F.regexp_replace(section_id, r"(?U)^\s+|\s+$", ""))
    )


def parse(text: Column) -> Column:
    """Distinct citations, in three passes: CFR, section sign, publications. Prose is no publication number."""
    empty = F.array().cast(REF)

    def ref(raw, root, subs, doc, lo, hi):
        return F.struct(raw.alias("raw"), root.alias("root"), subs.alias("subsections"), doc.alias("doc"), lo.cast("int").alias("page_lo"), hi.cast("int").alias("page_hi"))

    def numbered(pattern):
        def one(raw):
            number = F.regexp_extract(raw, pattern, 1)
            return ref(raw, F.concat(F.lit("29 CFR "), body(number)), subsections(number), F.lit(""), F.lit(None), F.lit(None))

        return one

    def published(raw):
        doc, lo, hi = (F.regexp_extract(raw, DOCUMENT, k) for k in (1, 2, 3))
        lo = F.when(lo != "", lo).cast("int")
        return ref(raw, F.concat(F.lit("OSHA "), F.upper(doc)), F.array().cast("array<string>"), F.upper(doc), lo, F.when(hi != "", hi).cast("int"))

    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    names = F.filter(found(DOCUMENT), lambda raw: F.regexp_extract(raw, DOCUMENT, 1).rlike(r"\d") | ~F.regexp_extract(raw, DOCUMENT, 1).rlike("[a-z]"))
    docs = F.transform(F.transform(names, published), lambda r: r.withField("page_hi", F.coalesce(r["page_hi"], r["page_lo"])))
    every = F.concat(F.transform(found(CFR), numbered(CFR)), F.transform(found(BARE), numbered(BARE)), docs)
    key = lambda r: F.struct(r["root"], r["subsections"], r["page_lo"], r["page_hi"])
    first = F.aggregate(every, empty, lambda seen, r: F.when(F.exists(seen, lambda s: key(s).eqNullSafe(key(r))), seen).otherwise(F.concat(seen, F.array(r))))
    return F.coalesce(first, empty)


def roots(text: Column) -> Column:
    return F.array_distinct(F.transform(parse(text), lambda r: r["root"]))


def chain_exists(text: Column, markers: Column) -> Column:
    """Each ``(marker)`` occurs after the one before, whatever its case; the earliest place of each is taken for good, so nothing is tried twice."""
    one = lambda m: F.concat(F.lit(r"(?>.*?\(\s*\Q"), m, F.lit(r"\E\s*\))"))
    pattern = F.concat(F.lit(r"(?is)\A"), F.array_join(F.transform(markers, one), ""))
    return F.when(F.size(markers) == 0, F.lit(True)).otherwise(F.call_function("rlike", text, pattern))


def pages(section_id: Column) -> tuple[Column, Column]:
    """First and last page of a publication's ``(pp. a-b)``, ``(p. a)`` or ``(pages a-b)``; null without."""
    lo, hi = (F.regexp_extract(section_id, DOCUMENT, k) for k in (2, 3))
    first = F.when(lo != "", lo).cast("int")
    return first, F.coalesce(F.when(hi != "", hi).cast("int"), first)


def status(root: Column, cited: Column, valid: Column) -> Column:
    """True for a valid root, false for a cited one that is not, else null."""
    return F.when(F.array_contains(valid, root), True).when(F.array_contains(cited, root), False)


def linked(text: Column) -> Column:
    """Citations in brackets as links, ``[id](#cite:id)``, the target percent-encoded."""
    encoded = lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%28"), F.lit("(")), F.lit("%29"), F.lit(")"))
    links = F.transform(F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(1)), lambda x: F.concat(F.lit("["), x, F.lit("](#cite:"), encoded(x), F.lit(")")))
    gaps = F.split(text, BRACKETED, -1)
    return F.array_join(F.flatten(F.zip_with(gaps, links, lambda g, x: F.array(g, F.coalesce(x, F.lit(""))))), "")


def _folded(label: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(label, r"(?U)\s+", " ")))


def is_invalid(label: Column, invalid: Column) -> Column:
    """Whether the label is among the invalid ones, whatever the case and the spaces."""
    return F.coalesce(F.array_contains(F.transform(invalid, _folded), _folded(label)), F.lit(False))


def source_for(sources: Column, selected: Column, opened: Column) -> Column:
    """The first source with the root of the selected id, else of the opened one, else the first; null without sources."""
    having = lambda one: F.get(F.filter(sources, lambda s: normalise(s["section_id"]) == normalise(one)), F.lit(0))
    return F.coalesce(having(selected), having(opened), F.get(sources, F.lit(0)))
