"""Cases at the edges of secret rules, letters and personal data."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from quern.llm import langid, pii, queries, secrets
from quern.llm.common import Scratch
from quern.llm.queries import pii_key

SCHEMA = "doc_id long, text string, lang string"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], SCHEMA)


# --- letters


def test_only_letters_make_a_language(spark):
    learn = docs(spark, ["the cat sat on the mat"] * 5 + ["le chat est sur la table"] * 5).withColumn("lang", F.when(F.col("doc_id") < 5, "en").otherwise("fr"))
    model = langid.train(learn, F.lit(True))
    texts = ["½ ² 12", "①", "Ⅷ", "Ⅻ ⅷ", "́̂", "_ 12", "٣٤", "🙂", "", None, "a", "ª", "字", "é"]
    out = {r.doc_id: r for r in langid.predict(spark, docs(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        assert (out[i].lang_pred == "und") == (regex.search(r"\p{L}", text or "") is None), text


# --- secrets

ALL_RULES = {
    "github": (["ghp_" + "a1" * 18, "ghs_" + "Z" * 40], ["ghp_short", "ghx_" + "a" * 36]),
    "slack": (["xoxb-1234567890", "xoxp-" + "a-b" * 9], ["xoxz-1234567890", "xoxb-123"]),
    "jwt": (["eyJhbGci.eyJzdWIi.c2ln", "eyJa_-b.eyJc_-d.e_-f"], ["eyJhbGci.eyJzdWIi", "xeyJhbGci.eyJzdWIi.c2ln", "eyJhbGci.abc.c2ln", "eyJ.eyJa.b"]),
    "private_key": (["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----"], ["-----BEGIN PUBLIC KEY-----", "-----begin private key-----"]),
    "assign": (["api_key = 'abcdef123456", "PASSWD:AbCdEfGhIjKl"], ["token=short"]),
    "access": (["AKIA" + "B2" * 7], ["AKIA12"]),
    "hex": (["0123456789abcdef"], ["0123456789abcde", "0123456789ABCDEF"]),
}


def test_every_rule_finds_its_kind_and_no_less(spark):
    yes = [(kind, t) for kind, (good, _) in ALL_RULES.items() for t in good]
    no = [(kind, t) for kind, (_, bad) in ALL_RULES.items() for t in bad]
    out = {r.doc_id: r.found for r in secrets.scan(docs(spark, [f"so ({t}) it" for _, t in yes + no]), Scratch(spark, "t")).collect()}
    for i, (kind, text) in enumerate(yes):
        assert [(x.kind, x.at, x.stop) for x in out[i] if x.kind == kind] == [(kind, 4, 4 + len(text))], text
    for i, (kind, text) in enumerate(no, len(yes)):
        assert not [x for x in out[i] if x.kind == kind], text


def test_rules_against_python(spark):
    random.seed(8)
    bits = [t for good, bad in ALL_RULES.values() for t in good + bad] + ["eyJ", ".", "-", " ", "ghp_", "xoxb", "=", "token", "\n", "ß", "🙂", "a" * 15, "-----BEGIN "]
    texts = ["".join(random.choices(bits, k=random.randint(1, 12))) for _ in range(300)]
    out = {r.doc_id: r.found for r in secrets.scan(docs(spark, texts), Scratch(spark, "t")).collect()}
    for i, text in enumerate(texts):
        want = [(m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in regex.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
        assert [(x.at, x.rule, x.stop) for x in out[i]] == sorted(want), text


def test_counts_of_the_query_are_those_of_its_spans(spark, tmp_path):
    hexes, token, access = "0123456789abcdef", "token=abcdefghijkl", "AKIA" + "B2" * 7
    texts = [hexes, f"{hexes} {token}", " ".join([hexes] * 3 + [token] * 2 + [access]), f"{access} {access} {token} {hexes}", "", None]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in queries.op1_secrets(spark, str(tmp_path)).collect()}
    assert out == {0: (0, 0, 1), 1: (1, 0, 1), 2: (2, 1, 3), 3: (1, 2, 1), 4: (0, 0, 0), 5: (0, 0, 0)}


@pytest.mark.parametrize("bit", ["eyJ", "eyJa.", ".eyJ", "-----BEGIN ", "PRIVATE KEY ", "token ", "password  ", "xoxb-", "ghp_", "AKIA", "abcdef", "secret=", "api_key'"])
def test_time_of_a_long_text_grows_with_its_length(spark, bit):
    def seconds(n):
        text = bit * (n // len(bit)) + " .eyJ token=abcdefghijkl"
        began = time.time()
        assert secrets.scan(docs(spark, [text, "ghp_" + "a" * 36, "xoxb-1234567890", "eyJa.eyJb.c", "-----BEGIN PRIVATE KEY-----"]), Scratch(spark, "t")).filter("size(found) > 0").count() >= 4
        return time.time() - began

    short = seconds(100)
    assert seconds(240_000) < short + 10


# --- personal data


def replaced(spark, texts):
    out = {r.doc_id: r for r in pii.replace(docs(spark, texts), Scratch(spark, "t"), "k").collect()}
    return [out[i].text for i in range(len(texts))], [list(out[i].entities) for i in range(len(texts))]


def test_names_behind_other_spaces_and_forms(spark):
    texts = ["Mr. Smith came", "Mr.\nSmith came", "Mr.\tSmith came", "MR. SMITH came. Then Smith left.", "M. Dupont vient", "Sir John Roe sat", "Lady Anna Berg sat", "Mlle Éva Dupont", "DR. SMITH said"]
    made, kinds = replaced(spark, texts)
    for text, new, kind in zip(texts, made, kinds):
        assert "name" in kind and not any(n in new for n in ("Smith", "SMITH", "Dupont", "John", "Roe", "Anna", "Berg", "Éva")), new
    smith = regex.fullmatch("Mr\\. (\\w+) came", made[0])[1]
    assert made[1] == f"Mr.\n{smith} came" and made[2] == f"Mr.\t{smith} came"
    assert made[3].startswith(f"MR. {smith.upper()} ") and made[3].endswith(f". Then {smith} left.") and made[8] == f"DR. {smith.upper()} said"
    clean = ["MS Word and M theory", "Plan M is on", "the mr smith", "Sr software", "Notre Dame Cathedral", "M.A. and so on", "Don't Stop"]
    assert replaced(spark, clean) == (clean, [[]] * len(clean))


def test_ibans_in_lower_case_and_cards_with_dots(spark):
    texts = ["de89370400440532013000", "DE89 3704 0044 0532 0130 00", "gb82 west 1234 5698 7654 32", "4539.1488.0343.6467", "4539148803436467"]
    made, kinds = replaced(spark, [f"x {t} y" for t in texts])
    a, b, c, d, e = (m[2:-2] for m in made)
    assert kinds == [["iban"]] * 3 + [["card"]] * 2
    assert a.islower() and a.upper() == b.replace(" ", "") != "DE89370400440532013000" and regex.fullmatch(r"gb\d\d [a-z]{4} \d{4} \d{4} \d{4} \d\d", c)
    assert d.count(".") == 3 and d.replace(".", "") == e != texts[4]
    clean = ["ab12cdef34567890", "1.2.3.4444", "word12 word", "de12 word word word word"]
    assert replaced(spark, clean) == (clean, [[]] * len(clean))


def test_replacement_against_a_python_version(spark):
    """What is found, by the same expressions in Python; outside of it nothing changes, and equal entities alone get equal surrogates."""
    random.seed(9)
    bits = ["Mr. Smith", "Mrs. Anna Berg", "a.b@c.org", "A.B@c.org", "10.1.2.3", "+49 30 1234567", "4539 1488 0343 6467", "123-45-6789", "DE89370400440532013000", "2001:db8::1", "M. Dupont", "Dr. J. Roe", "1234", "…", "ß", "🙂", "\n"]
    texts = [" ; ".join(random.choices(bits, k=random.randint(1, 9))) for _ in range(120)]
    made, kinds = replaced(spark, texts)
    pattern = regex.compile("|".join(f"(?P<{k}>{p.replace(chr(92) + '1', chr(92) + 'g<gap>').replace('([' + chr(92) + 'x20.-])', '(?P<gap>[' + chr(92) + 'x20.-])')})" for k, p in pii._KINDS))
    seen = {}
    for text, new, kind in zip(texts, made, kinds):
        mentions = list(pattern.finditer(text))
        assert [m.lastgroup if m.lastgroup != "gap" else "card" for m in mentions] == kind, text
        gaps = [text[a:b] for a, b in zip([0, *(m.end() for m in mentions)], [*(m.start() for m in mentions), len(text)])]
        out = regex.fullmatch("(.*)".join(map(regex.escape, gaps)), new, regex.DOTALL)
        assert out, (text, new)
        for m, other in zip(mentions, out.groups()):
            assert other != m[0] and seen.setdefault(m[0], other) == other
    assert len({v.lower() for v in seen.values()}) == len({k.lower() for k in seen})


def test_a_key_that_nobody_knows(spark):
    assert pii_key(spark) == pii_key(spark) and len(pii_key(spark)) == 64
    spark.conf.set("spark.quern.pii.key", "mine")
    try:
        assert pii_key(spark) == "mine"
    finally:
        spark.conf.unset("spark.quern.pii.key")
