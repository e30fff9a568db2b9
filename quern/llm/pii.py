"""PII: detected entities get keyed surrogates of the same type; DataFrame functions only.

Found are e-mail addresses, card numbers, IBANs, US social security numbers, phone
numbers (with a country code, in the North American form, or national with a leading
0), IPv4 and IPv6 addresses, and names
after one or more forms of address (also in capitals, and with a no-break space, a tab or a line's end behind), with any number of words, initials, hyphens and
apostrophes (a possessive 's is no part of them). A mention is one or more parts; each
part is an entity (kind and canonical value) whose surrogate keeps its format: digits
stay digits, letters stay letters of their case and script (Latin or Cyrillic),
separators stay, a country code and an IBAN's country stay, a number that passes the
Luhn test or an IBAN's check still does and one that fails still fails, an address
stays an address, a first name keeps the gender of its form of address. A form without a gender
(or none) takes that of the same first name's other mentions: the only one in the
corpus, or else the only one in the document, or else none. Initials become other
letters; particles (von, de) and the O of O'Brien stay.

Name words of a document are also replaced where they stand without a form of address
in it, as capitalised words; one that is both a first and a last name counts as first.

Names that never stand behind a form of address of the list below are not found.

Surrogates are drawn from HMAC-SHA512 under the key, of the entity (a first name with
its gender) alone, so all mentions of an entity, in any document, get the same one. A collision check over all entities of the
corpus moves an entity on to its next surrogate until no two share one and none equals
a real entity of its kind. Collisions that are left after ``rounds`` raise.

Texts are joined with what was found in them through a broadcast bitmap of fixed size
(``common.apart``), so texts without entities are not shuffled.

Null texts stay null, empty ones empty. All rows and columns are kept; a row without
an id is treated as all others. Two rows with the same id and text are the same.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, apart

# Forms of address, and the syllables that surrogate names are made of.
MALE = ("Mr", "Sir", "Lord", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Господин", "MR", "SIR", "HERR", "SEÑOR", "MONSIEUR", "ГОСПОДИН")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Señora", "Señorita", "Sra", "Srta", "Doña", "Madame", "Mademoiselle", "Mme", "Mlle", "Госпожа", "MRS", "FRAU", "SEÑORA", "MADAME", "ГОСПОЖА")
NEUTRAL = ("Dr", "Prof", "Rev")
# only with a full stop behind: without one they are other words
MALE_DOTTED, FEMALE_DOTTED, NEUTRAL_DOTTED = ("M", "SR", "Hr"), ("MS", "SRA", "MME"), ("DR", "PROF")
PARTICLES = ("von", "van", "vom", "zu", "zum", "zur", "de", "del", "della", "der", "den", "des", "di", "da", "do", "dos", "du", "la", "le", "el", "al", "ter", "ten", "y", "d")
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga go ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te ti to va vi za".split(),
    "cyrillic": "ба бе би бо да де ди до га го ка ке ки ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си та те ти то ва ви за".split(),
}
ENDINGS = {
    "latin": {"male": ["n", "s", "rd", "k"], "female": ["na", "lia", "ra", "tha"], "any": ["l", "m"], "last": ["ner", "son", "rez", "ley", "mann", "let"]},
    "cyrillic": {"male": ["н", "р", "с", "м"], "female": ["на", "лия", "ра", "та"], "any": ["ль"], "last": ["нов", "рин", "ско", "чук"]},
}

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
# Fixed value: countries whose IBANs are looked for in lower case, too.
_LANDS = "ad ae al at az ba be bg br ch cy cz de dk ee es fi fo fr gb ge gi gr hr hu ie il is it kz lb li lt lu lv mc md me mk mt mu nl no pk pl ps pt qa ro rs sa se si sk sm tn tr ua vg xk".replace(" ", "|")
# in lower case only the first four places behind the check digits may be letters
IBAN = rf"(?<![\p{{L}}\p{{N}}])(?:[A-Z]{{2}}\d{{2}}(?:\x20?[A-Z0-9]{{4}}){{3,7}}(?:\x20?[A-Z0-9]{{1,3}})?|(?=[a-z]{{2}}\d)(?:{_LANDS})\d{{2}}\x20?(?:[a-z]{{4}}|\d{{4}})(?:\x20?\d{{4}}){{2,6}}(?:\x20?\d{{1,3}})?)(?![\p{{L}}\p{{N}}])"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)"
_H = "[0-9A-Fa-f]{1,4}"
_V4 = r"(?:\d{1,3}\.){3}\d{1,3}"
# all groups; or :: with at least one group before or after it, longest first
IPV6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_H}:){{6}}(?:{_V4}|{_H}:{_H})|(?:{'|'.join(f'(?:{_H}:){{{n}}}(?::{_H}){{0,{6 - n}}}:(?:{_V4}|{_H})' for n in range(6, 0, -1))}|:(?::{_H}){{0,5}}:(?:{_V4}|{_H})|(?:{_H}:){{1,7}}:))(?![\p{{L}}\p{{N}}:]|\.\d)"
SSN = r"(?<![\p{L}\p{N}-])\d{3}(?:-\d{2}-|\x20\d{2}\x20)\d{4}(?![\p{L}\p{N}-])"
CARD = r"(?<![\p{L}\p{N}])(?:(?!00)\d{13,19}|\d{4}([\x20.-])(?:\d{4}\1\d{4}\1\d{1,7}|\d{6}\1\d{4,5}))(?![\p{L}\p{N}])"
# 01.02.2024 is no national number: its first part is longer than two digits, or all are pairs
_NATIONAL = r"(?<!\d[.,/-])(?:0[1-9]\d{1,3}(?:\x20?[/-]\x20?|[\x20.])?|\(0[1-9]\d{0,3}\)[\x20.-]?)\d{3,4}(?:[\x20.-]?\d{2,4}){1,2}|(?<!\d[.,/-])0[1-9](?:(?:\x20\d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})"
PHONE = rf"(?<![\p{{L}}\p{{N}}+])(?:(?:\+|00)(?=(?:[\x20.()-]{{0,3}}\d){{7}})\d{{1,3}}[\x20.-]?(?:\(\d{{1,4}}\)[\x20.-]?)?\d{{1,4}}(?:[\x20.-]?\d{{2,4}}){{1,4}}|(?:\(\d{{3}}\)[\x20.-]?|\d{{3}}[\x20.-])\d{{3}}[\x20.-]\d{{4}}|{_NATIONAL})(?![\p{{L}}\p{{N}}])"
# Fixed value: international calling codes of one and two digits; all others have three.
CALLING = r"(?:\+|00)(?:1|7|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_TITLES = "|".join((*MALE, *FEMALE, *NEUTRAL, rf"(?:{'|'.join((*MALE_DOTTED, *FEMALE_DOTTED, *NEUTRAL_DOTTED))})(?=\.)"))
#: What may stand between the words of a name, and behind a form of address.
_GAP = r"[\x20\xA0\u202F]"
_AFTER = r"(?:[\x20\xA0\u202F\t]|\r?\n)"
# possessive loops, which Java runs without recursion however long a text's run of name words is
_WORD = rf"(?!(?:{_TITLES})(?!\p{{L}}))\p{{Lu}}(?:[\p{{L}}\p{{M}}]|-(?=\p{{L}})|['’](?=\p{{L}})(?![sS](?![\p{{L}}\p{{N}}])))++(?![\p{{L}}\p{{N}}])"
_LEAD = rf"(?:\p{{Lu}}(?:\.(?:{_GAP}|-)?|{_GAP})|(?:{'|'.join(PARTICLES)}){_GAP}|d['’])*+"
_FORMS = rf"(?:(?:{_TITLES})(?:\.{_AFTER}?|{_AFTER}))++"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}}){_FORMS}{_LEAD}{_WORD}(?:{_GAP}{_LEAD}{_WORD})*+"
#: A capitalised word, which may repeat a name of its document. Letters only, so that no other mention can begin inside.
BARE = r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}\p{M}]++(?!\p{N})"
_KINDS = (("email", EMAIL), ("iban", IBAN), ("ip", IP), ("ipv6", IPV6), ("ssn", SSN), ("card", CARD), ("phone", PHONE), ("name", NAME))
ALL = "|".join(p.replace(r"\1", r"\k<gap>").replace(r"([\x20.-])", r"(?<gap>[\x20.-])") for _, p in _KINDS)
ALL_BARE = f"{ALL}|{BARE}"
#: Texts without any of these hold no entity.
HINT = rf"@|::|(?:{_H}:){{6}}|\d{{4}}|\d\.\d|\d[\x20.()/-]+\d|(?=\p{{Lu}})(?:{'|'.join((*MALE, *FEMALE, *NEUTRAL, *MALE_DOTTED, *FEMALE_DOTTED, *NEUTRAL_DOTTED))})[.\x20\xA0\u202F\t\r\n]"

def _kind(mention: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(_KINDS[:-1]):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _parts(mention: Column, kind: Column) -> Column:
    """``array<struct<kind, value>>``; a part of kind null is kept as it stands."""
    part = lambda k, v: F.struct(F.lit(k).cast("string").alias("kind"), v.alias("value"))
    title = F.regexp_extract(mention, f"^{_FORMS}", 0)
    rest = F.substring(mention, F.length(title) + 1, F.length(mention))
    last = F.regexp_extract(rest, r"[^\x20\xA0\u202F.]+$", 0)
    # a variable of a lambda is evaluated once, not once a piece
    bound = F.array(F.struct(title.alias("title"), F.substring(rest, F.lit(1), F.length(rest) - F.length(last)).alias("first"), last.alias("last")))
    pieces = lambda text: F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0))
    split = lambda text, k: F.transform(pieces(text), lambda x: F.struct(F.when(x.rlike(r"^\p{L}") & ~x.isin(*PARTICLES), k(x)).alias("kind"), x.alias("value")))

    def named_parts(b):
        words = F.regexp_extract_all(b["title"], F.lit(r"\p{L}+"), F.lit(0))
        has = lambda forms: F.exists(words, lambda w: w.isin(*forms))
        male, female = has((*MALE, *MALE_DOTTED)), has((*FEMALE, *FEMALE_DOTTED))
        gender = F.when(male & ~female, "male").when(female & ~male, "female").otherwise("any")
        return F.concat(
            F.array(part(None, b["title"])),
            split(b["first"], lambda x: F.when(F.length(x) == 1, "initial").otherwise(gender)),
            split(b["last"], lambda x: F.when(F.length(x) > 1, "last").when(~b["last"].rlike("['’]"), "initial")),
        )

    named = F.transform(bound, named_parts)[0]
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), mention.alias("value"))))


def _canonical(kind: Column, value: Column) -> Column:
    plain = F.regexp_replace(value, r"[\x20.()/-]", "")
    # all eight groups; the two of an address that ends as IPv4 stay in that form
    groups = lambda text: F.transform(F.filter(F.split(text, ":"), lambda g: g != ""), lambda g: F.when(g.contains("."), g).otherwise(F.lpad(g, 4, "0")))
    halves = F.split(F.lower(value), "::")
    left, right = groups(halves[0]), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    zeros = F.greatest(F.lit(0), 8 - F.size(left) - F.size(right) - F.when(value.contains("."), 1).otherwise(0))
    ipv6 = F.array_join(F.concat(left, F.array_repeat(F.lit("0000"), zeros), right), ":")
    # a name in capitals is the name
    name = F.when(value.rlike(r"^\p{Lu}{2,}$"), F.concat(F.substring(value, 1, 1), F.lower(F.substring(value, F.lit(2), F.length(value))))).otherwise(value)
    return F.when(kind == "email", F.lower(value)).when(kind == "ipv6", ipv6).when(kind == "iban", F.upper(plain)).when(kind.isin("ssn", "card", "phone"), plain).otherwise(name)


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA512 in hex."""
    raw = key.encode()
    raw = hashlib.sha512(raw).digest() if len(raw) > 128 else raw
    pad = lambda byte: F.lit(bytes(x ^ byte for x in raw.ljust(128, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 512))
    return F.sha2(F.concat(pad(0x5C), inner), 512)


def _stream(key: str, kind: Column, canon: Column, tries: Column) -> Column:
    """512 keyed hex digits."""
    return F.concat(*[_hmac(key, F.concat_ws("|", kind, tries.cast("string"), F.lit(str(k)), canon)) for k in range(4)])


def _draw(stream: Column, at: Column | int, n: int) -> Column:
    """A keyed number below n from the at-th four digits."""
    at = F.lit(at) if isinstance(at, int) else at
    return (F.conv(F.substring(stream, F.pmod(at, F.lit(128)) * 4 + 1, F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _pick(stream: Column, at: Column | int, choices: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in choices]), _draw(stream, at, len(choices)) + 1)


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    numbers = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x) % 10


def _rest97(text: Column) -> Column:
    """An IBAN's digits, letters as 10 to 35, modulo 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike(r"\d"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def _letters(value: Column, stream: Column) -> Column:
    """Each digit or letter replaced by another of its kind; the rest stays."""
    def one(c, i):
        latin = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(stream, i, 26) + 1, F.lit(1))
        cyrillic = F.substring(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), _draw(stream, i, 27) + 1, F.lit(1))
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)
        return F.when(c.rlike(r"\d"), _draw(stream, i, 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def surrogate(key: str, kind: Column, canon: Column, tries: Column) -> Column:
    """The canonical surrogate of an entity."""
    s = _stream(key, kind, canon, tries)
    user = F.regexp_extract(canon, "^([^@]*)@", 1)
    email = F.concat(_letters(user, s), F.lit("@"), F.lower(_letters(F.regexp_extract(canon, r"@(.*)\.[^.]+$", 1), F.substring(s, 65, 448))), F.lit("."), F.regexp_extract(canon, r"([^.]+)$", 1))
    ip = F.concat_ws(".", *[(_draw(s, k, 254) + 1).cast("string") for k in range(4)])
    ipv6 = F.regexp_replace(F.substring(s, 1, 32), r"(.{4})(?!$)", "$1:")
    body = _letters(F.substring(canon, F.lit(1), F.length(canon) - 1), s)
    need = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    off = F.when(_luhn(canon) == 0, F.lit(0)).otherwise(_draw(s, 120, 9) + 1)
    card = F.concat(body, ((need + off) % 10).cast("string"))
    land, account = F.substring(canon, 1, 2), _letters(F.substring(canon, F.lit(5), F.length(canon)), s)
    check = 98 - _rest97(F.concat(account, land, F.lit("00")))
    held = _rest97(F.concat(F.substring(canon, F.lit(5), F.length(canon)), F.substring(canon, 1, 4))) == 1
    wrong = F.pmod(check - 1 + _draw(s, 120, 96), F.lit(97)) + 2
    iban = F.concat(land, F.lpad(F.when(held, check).otherwise(wrong).cast("string"), 2, "0"), account)
    lead = F.regexp_extract(canon, rf"^({CALLING}|0)", 1)
    phone = F.concat(lead, _letters(F.substring(canon, F.length(lead) + 1, F.length(canon)), s))
    names = F.lit(None).cast("string")
    for script, endings in ENDINGS.items():
        for gender, ends in endings.items():
            made = F.concat(F.initcap(F.concat(*[_pick(s, k, SYLLABLES[script]) for k in range(3 if gender == "last" else 2)])), _pick(s, 9, ends))
            # a later try is longer, so names never run out
            longer = F.when(tries > 3, F.concat(made, _pick(s, 11, SYLLABLES[script]), _pick(s, 12, SYLLABLES[script]), _pick(s, 13, ends))).otherwise(made)
            mine = (kind == gender) & (canon.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else ~canon.rlike(r"\p{IsCyrillic}"))
            names = F.when(mine, longer).otherwise(names)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", phone).when(kind == "ssn", _letters(canon, s)).otherwise(names)


def _shaped(value: Column, made: Column) -> Column:
    """The canonical surrogate in the mention's own format: with its separators."""
    marks = r"[\x20.()/-]"
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    # the n-th character that is no separator becomes the n-th of the surrogate
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))
    folded = F.aggregate(chars, start, lambda a, c: F.when(c.rlike(marks), F.struct(a["n"], F.concat(a["out"], c).alias("out"))).otherwise(F.struct((a["n"] + 1).alias("n"), F.concat(a["out"], F.substring(made, a["n"] + 1, F.lit(1))).alias("out"))))
    return folded["out"]


def _cased(value: Column, made: Column) -> Column:
    """The surrogate with capitals where the mention has them; as it is if their lengths differ."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    own = F.array_join(F.zip_with(chars(value), chars(made), lambda c, m: F.when(c.rlike(r"\p{Lu}"), F.upper(m)).otherwise(m)), "")
    return F.when(F.length(value) == F.length(made), own).otherwise(made)


def _found(docs: DataFrame, pattern: str, kind) -> DataFrame:
    """``id, hash, place, type, part, kind, value, canon`` of all matches in ``docs (id, hash, text)``."""
    found = docs.select("id", "hash", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("place", "mention"))
    kinds = found.withColumn("type", kind(F.col("mention")))
    parts = kinds.select("id", "hash", "place", "type", F.posexplode(_parts(F.col("mention"), F.col("type"))).alias("part", "x"))
    return parts.select("id", "hash", "place", "type", "part", "x.kind", "x.value", _canonical(F.col("x.kind"), F.col("x.value")).alias("canon")).distinct()


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.hash") == F.col(f"{b}.hash"))


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``id, hash, place, type, part, kind, value, canon``: the parts of all mentions, in order, as a written table.

    In documents with names the places count the capitalised words too; their type is
    null unless they repeat a name.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mentions")
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    plain = scratch.save(_found(rows.filter(F.col("text").rlike(HINT)), ALL, _kind))
    names = plain.filter("type = 'name' and kind in ('male', 'female', 'any', 'last')").select("id", "hash", "kind", "canon").distinct()
    firsts = names.filter("kind <> 'last'")
    only = lambda df, *by: df.filter("kind <> 'any'").groupBy(*by).agg(F.min("kind").alias("g0"), F.max("kind").alias("g1")).filter("g0 = g1").select(*by, F.col("g0").alias("gender"))
    everywhere = scratch.save(only(firsts, "canon"))
    here = only(firsts, "id", "hash", "canon")
    a = firsts.join(everywhere, "canon", "left").withColumnRenamed("gender", "wide").alias("a")
    b = here.alias("b")
    seen = a.join(b, _same_row("a", "b") & (F.col("a.canon") == F.col("b.canon")), "left")
    one = F.when(F.col("a.kind") == "any", F.coalesce("a.wide", "b.gender", F.lit("any"))).otherwise(F.col("a.kind"))
    resolved = seen.select("a.id", "a.hash", "a.canon", "a.kind", one.alias("now")).unionByName(names.filter("kind = 'last'").select("id", "hash", "canon", "kind", F.col("kind").alias("now")))
    resolved = scratch.save(resolved)

    held = scratch.save(plain.filter("type = 'name'").select("id", "hash").distinct())
    n = held.alias("n")
    maybe, _ = apart(rows, "hash", held.withColumnRenamed("hash", "held_hash"), "held_hash", scratch)
    again = maybe.alias("r").join(n, _same_row("r", "n")).select("r.id", "r.hash", "r.text")
    every = _found(again, ALL_BARE, lambda m: F.when(~m.rlike(f"^(?:{BARE})$"), _kind(m)).otherwise("bare")).alias("e")
    # a mention's own kind, or for a bare word that of the name it repeats
    own = resolved.select("id", "hash", "canon", "kind", "now")
    bare = resolved.groupBy("id", "hash", "canon").agg(F.max(F.struct(F.col("now") != "last", "now"))["now"].alias("now")).select("id", "hash", "canon", F.lit("bare").alias("kind"), "now")
    key = own.unionByName(bare).alias("k")
    joined = every.join(key, _same_row("e", "k") & (F.col("e.canon") == F.col("k.canon")) & (F.col("e.kind") == F.col("k.kind")), "left")
    is_bare = F.col("e.type") == "bare"
    kind = F.coalesce(F.col("k.now"), F.when(~is_bare, F.col("e.kind")))
    mention = F.when(is_bare, F.when(F.col("k.now").isNotNull(), "name")).otherwise(F.col("e.type"))
    named = joined.select("e.id", "e.hash", "e.place", mention.alias("type"), "e.part", kind.alias("kind"), "e.value", "e.canon")
    x = plain.alias("x")
    rest = x.join(n, _same_row("x", "n"), "left_anti")
    return scratch.save(rest.unionByName(named))


def entities(mentioned: DataFrame, key: str, scratch: Scratch, rounds: int = 20) -> DataFrame:
    """``kind, canon, made``: one surrogate for each entity, no two alike, none a real entity of its kind."""
    real = scratch.save(mentioned.filter("kind is not null and kind <> 'initial'").select("kind", "canon").distinct())
    left = real.withColumn("tries", F.lit(0))
    taken = None
    out = []
    for _ in range(rounds):
        tried = scratch.save(left.withColumn("made", surrogate(key, F.col("kind"), F.col("canon"), F.col("tries"))))
        # the smallest entity keeps a shared surrogate
        first = tried.groupBy("kind", "made").agg(F.min("canon").alias("owner"))
        good = tried.join(first, ["kind", "made"]).filter("canon = owner").join(real.select("kind", F.col("canon").alias("made")), ["kind", "made"], "left_anti")
        if taken is not None:
            good = good.join(taken.select("kind", "made"), ["kind", "made"], "left_anti")
        good = scratch.save(good.select("kind", "canon", "made"))
        out.append(good)
        taken = good if taken is None else taken.unionByName(good)
        left = scratch.save(tried.join(good.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("tries") + 1).alias("tries")))
        if left.isEmpty():
            return taken
    raise ValueError(f"surrogates still collide after {rounds} rounds")


def replace(docs: DataFrame, scratch: Scratch, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their entities replaced, and as last column ``entities array<string>``: the kinds found, in order.

    If ``docs`` has a column of that name (in any case), the new one gets underscores behind.
    """
    found = mentions(docs, id_col, text_col, scratch)
    named = entities(found, key, scratch)
    # parts that are kept or drawn on the spot stay out of the join: titles and spaces would be a few hot keys
    joins = F.coalesce(F.col("kind") != "initial", F.lit(False))
    parts = found.filter(joins).join(named, ["kind", "canon"], "left").unionByName(found.filter(~joins), allowMissingColumns=True)
    letter = _letters(F.col("value"), _stream(key, F.col("kind"), F.col("canon"), F.lit(0)))
    numbers = F.col("kind").isin("card", "phone", "ssn", "iban")
    small, large = F.col("value") == F.lower("value"), F.col("value").rlike(r"^\p{Lu}{2,}$")
    shaped = F.when(F.col("kind").isNull(), F.col("value")).when(F.col("kind") == "initial", letter).when(numbers, _shaped(F.col("value"), F.when(small, F.lower("made")).otherwise(F.col("made")))).when(F.col("kind") == "email", _cased(F.col("value"), F.col("made"))).when(large, F.upper("made")).otherwise(F.col("made"))
    whole = lambda c: F.array_sort(F.collect_list(c))
    # a mention has a few parts, and a document as many mentions as its text has room for
    by_place = parts.groupBy("id", "hash", "place", "type").agg(whole(F.struct("part", shaped.alias("s"))).alias("p")).select("id", "hash", "place", "type", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("s"))
    by_doc = scratch.save(by_place.groupBy("id", "hash").agg(whole(F.struct("place", "type", "s")).alias("found")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id0"), F.xxhash64(F.col(text_col)).alias("hash0"), F.col(text_col).alias("text0"))
    maybe, sure = apart(row, "hash0", by_doc, "hash", scratch)
    joined = maybe.join(by_doc, F.col("id0").eqNullSafe(F.col("id")) & (F.col("hash0") == F.col("hash")), "left").drop("id", "hash").unionByName(sure, allowMissingColumns=True)
    gaps = F.when(F.exists("found", lambda x: x["type"].isNull() | (x["type"] == "name")), F.split("text0", ALL_BARE, -1)).otherwise(F.split("text0", ALL, -1))
    made = F.array_join(F.flatten(F.zip_with(gaps, F.transform("found", lambda x: x["s"]), lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    text = F.when(F.col("found").isNull(), F.col("text0")).otherwise(made)
    kinds = F.coalesce(F.filter(F.transform("found", lambda x: x["type"]), lambda t: t.isNotNull()), F.array().cast("array<string>"))
    columns = [text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    name = "entities"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return joined.select(*columns, kinds.alias(name))
