"""English stems by the Porter2 rules, over a table of distinct words: each rule is a projection, so a word costs a few expressions in the JVM.

A word's regions R1 and R2 begin behind the first consonant that follows a vowel, and behind the
next such place; most endings go only inside one of them. ``y`` counts as a consonant, marked ``Y``, at
the beginning and behind a vowel.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of Porter2.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LONG_PREFIXES = ("gener", "commun", "arsen")
ENDINGS_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
ENDINGS_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
ENDINGS_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "[cdeghkmnrt]"
VOWEL, CONSONANT = "[aeiouy]", "[^aeiouy]"
REGION = f"^{CONSONANT}*{VOWEL}+{CONSONANT}"
SHORT_SYLLABLE = f"(?:{CONSONANT}{VOWEL}[^aeiouywxY]|^{VOWEL}{CONSONANT})$"


def either(endings) -> str:
    """One of the endings at a word's end; a search finds the longest."""
    return f"({'|'.join(endings)})$"


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs.items())))


def _cut(word: Column, n) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def with_stems(words: DataFrame, word: str = "term", stem: str = "stem") -> DataFrame:
    """``words`` with the stems of its lower-case column ``word``; null stays null."""
    w, r1, r2, end = F.col("_w"), F.col("_r1"), F.col("_r2"), F.col("_end")
    base = F.length(w) - F.length(end)
    rows = words.withColumn("_w", F.regexp_replace(word, "^'", ""))
    rows = rows.withColumn("_w", F.regexp_replace(F.regexp_replace("_w", "^y", "Y"), f"({VOWEL})y", "$1Y"))
    first = F.regexp_extract(w, f"^(?:{'|'.join(LONG_PREFIXES)})|{REGION}", 0)
    rows = rows.withColumn("_r1", F.when(first != "", F.length(first)).otherwise(F.length(w)))
    second = F.regexp_extract(F.substring(w, r1 + 1, F.length(w)), REGION, 0)
    rows = rows.withColumn("_r2", F.when(second != "", r1 + F.length(second)).otherwise(F.length(w)))
    rows = rows.withColumn("_w", F.regexp_replace("_w", "('s'|'s|')$", ""))
    # 1a
    rows = rows.withColumn("_end", F.regexp_extract("_w", either(("sses", "ied", "ies", "us", "ss", "s")), 1))
    plural = F.when(end == "sses", _cut(w, 2)).when(end.isin("ied", "ies"), _cut(w, F.when(F.length(w) > 4, 2).otherwise(1))).when((end == "s") & w.rlike(f"{VOWEL}.+s$"), _cut(w, 1)).otherwise(w)
    rows = rows.withColumn("_w", plural).withColumn("_done", F.col("_w").isin(*FINISHED))
    # 1b
    rows = rows.withColumn("_end", F.regexp_extract("_w", either(("eedly", "ingly", "edly", "eed", "ing", "ed")), 1)).withColumn("_b", F.substring(w, F.lit(1), base))
    b = F.col("_b")
    mended = F.when(b.rlike("(?:at|bl|iz)$"), F.concat(b, F.lit("e"))).when(b.rlike(either(DOUBLES)), _cut(b, 1)).when((F.length(b) <= r1) & b.rlike(SHORT_SYLLABLE), F.concat(b, F.lit("e"))).otherwise(b)
    past = F.when(end.isin("eed", "eedly"), F.when(base >= r1, F.concat(b, F.lit("ee"))).otherwise(w)).when((end != "") & b.rlike(VOWEL), mended).otherwise(w)
    rows = rows.withColumn("_w", F.when(F.col("_done"), w).otherwise(past))
    # 1c
    rows = rows.withColumn("_w", F.when(~F.col("_done") & w.rlike(f"^.+{CONSONANT}[yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    # 2 and 3
    for endings in (ENDINGS_2, ENDINGS_3):
        rows = rows.withColumn("_end", F.regexp_extract("_w", either(endings), 1))
        may = F.when(end == "ogi", w.rlike("logi$")).when(end == "li", w.rlike(f"{BEFORE_LI}li$")).when(end == "ative", base >= r2).otherwise(F.lit(True))
        changed = F.concat(F.substring(w, F.lit(1), base), F.try_element_at(_table(endings), end))
        rows = rows.withColumn("_w", F.when(~F.col("_done") & (end != "") & (base >= r1) & may, changed).otherwise(w))
    # 4
    rows = rows.withColumn("_end", F.regexp_extract("_w", either(ENDINGS_4), 1))
    goes = (end != "") & (base >= r2) & ((end != "ion") | w.rlike("[st]ion$"))
    rows = rows.withColumn("_w", F.when(~F.col("_done") & goes, F.substring(w, F.lit(1), base)).otherwise(w))
    # 5
    before = F.length(w) - 1
    last = (w.rlike("e$") & ((before >= r2) | ((before >= r1) & ~_cut(w, 1).rlike(SHORT_SYLLABLE)))) | (w.rlike("ll$") & (before >= r2))
    rows = rows.withColumn("_w", F.lower(F.when(~F.col("_done") & last, _cut(w, 1)).otherwise(w)))
    whole = F.when(F.length(word) <= 2, F.col(word)).otherwise(F.coalesce(F.try_element_at(_table(SPECIAL), F.col(word)), w))
    return rows.withColumn(stem, whole).select(*words.columns, stem)
