"""Text expressions: words, sentences, token counts, cleaning. All are columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content.
STOP_WORDS = (
    "a an the is are was were be been being do does did what which who whom whose "
    "when where why how of in on at to for from with by under over about into "
    "i me my we our you your he she it they them as and or if then than so not "
    "can could should would may might must will shall"
).split()
# The short English stop list of lexical search with stems.
SEARCH_STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
# Where a sentence ends and the next begins, and lines that are page furniture.
SENTENCE_GAP = r"(?<=[.;:!?])\s+(?=[A-Z(§])"
NOISE_LINE = r"(?i)^(?:\s*\d+\s*|OSHA\s*\d{3,4}[A-Za-z0-9\- ]*|www\.osha\.gov\s*|1-800-321-OSHA.*|Occupational Safety and Health Administration\s*)$"
GREETING = r"(?i)^(hi|hey|hello|yo|sup|howdy|thanks|thank you|thx|ty|ok|okay|cool|nice|great|good (morning|afternoon|evening|day))(\s+(there|everyone|everybody|all|friend|friends|team|guys|sir|ma'am|am|man))?[\s!.,?]*$"
META = r"(?i)\b(who are you|what are you|what(?:'s| is) your name|what can you do|how do you work|what do you know|can you help|help me understand you)\b"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def content_words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 that are no stop words, in order; the stop words are looked up, an expression would try each at every word."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))


def search_words(text: Column) -> Column:
    """Lower-case words of two or more characters of any script that are no stop words, in order, not yet stemmed."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*SEARCH_STOP_WORDS))


def sentences(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, SENTENCE_GAP), strip), lambda s: s != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def count_tokens(text: Column) -> Column:
    """The offline token count: runs of word characters, and other visible characters one by one."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")), F.lit(0))


def overlap(query: Column, other: Column) -> Column:
    """Share of the query's distinct words that the other has; 0 without words."""
    distinct = F.array_distinct(query)
    return F.when(F.size(distinct) > 0, F.size(F.array_intersect(distinct, other)) / F.size(distinct)).otherwise(F.lit(0.0))


def without_noise_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(NOISE_LINE)), " ")


def is_conversational(text: Column) -> Column:
    own = strip(text)
    return own.rlike(GREETING) | own.rlike(META)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with 1e-9 added to the product of the norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def l2_normalise(vector: Column) -> Column:
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: x / (norm + 1e-12))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def score_bar(value: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0.02), F.least(F.lit(1.0), (value - lo) / (hi - lo)))


def short_id() -> Column:
    """12 hex digits; not repeatable."""
    return F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 12)
