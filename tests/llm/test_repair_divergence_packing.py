import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from quern.llm import divergence, packing, queries, repair
from quern.llm.common import Scratch

# --- repair

CONVERSATIONS = "conv_id long, turn long, role string, text string, fault string, key int, cost string"


def cheapest(rows):
    """The least (cost, audit) over all edits, by states between rows instead of a chart."""
    more = lambda v, c, s: None if v is None else (v[0] + c, v[1] + s)
    best = lambda *xs: min((x for x in xs if x is not None), default=None)
    begin, head, asked, told = (0, ""), None, None, None
    for row in [*rows, None]:
        asked = best(asked, *(more(v, 2, "I") for v in (begin, head, told)))
        told = best(told, more(asked, 2, "I"))
        if row is None:
            return best(begin, told)
        new = [more(v, 3, "D") for v in (begin, head, asked, told)]
        if row != "-":
            cut, row = int(row.isupper()), row.lower()
            if row == "s":
                new[1] = best(new[1], more(begin, cut, "K"))
            user, other = ((cut, "K") if row == who else (2 + cut, "R") for who in "ua")
            new[2] = best(new[2], *(more(v, *user) for v in (begin, head, told)))
            new[3] = best(new[3], more(asked, *other))
        begin, head, asked, told = new


def brute_repair(rows):
    """The whole contract of op11 over ``rows (conv_id, turn, role, text)``."""
    out = {}
    for conv in {r[0] for r in rows}:
        held = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            held += [(turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in held:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
            seen.add((role, text))
        turns = {r[0] for r in held if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held))
        cost, audit = cheapest([repair.symbol(r[1], f) for r, f in zip(held, faults)])
        said, rest = [], iter(held)
        for edit in audit:
            row = next(rest) if edit != "I" else (None, "", "")
            wanted = "assistant" if said and said[-1][0][:1] == "u" else "user"
            if edit != "D":
                said.append((row[1] if edit == "K" else wanted, row[2]))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in said)) and next(rest, None) is None
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def run_repair(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONVERSATIONS).repartition(3)
    made = repair.repair_all(repair.damaged(df), df, Scratch(spark, "t"), **how).collect()
    out = {r[0]: tuple(r)[1:] for r in made}
    assert len(out) == len(made)
    return out


def test_chart_against_states():
    random.seed(1)
    for _ in range(1500):
        word = "".join(random.choice("suaxSUAX-uaua") for _ in range(random.randint(0, 12)))
        assert repair.repaired(word) == cheapest(word), word


def test_cheapest_against_every_edit():
    """All edits of short conversations, with no more insertions than can pay."""

    def ways(word, audit="", cost=0, roles=""):
        if re.fullmatch("(s?(ua)+)?", roles) and not word:
            yield cost, audit
        if audit.count("I") < 2:
            for who in "ua":
                yield from ways(word, audit + "I", cost + 2, roles + who)
        if word:
            row, rest = word[0], word[1:]
            yield from ways(rest, audit + "D", cost + 3, roles)
            if row != "-":
                cut = int(row.isupper())
                yield from ways(rest, audit + "K", cost + cut, roles + row.lower())
                for who in "ua":
                    yield from ways(rest, audit + "R", cost + 2 + cut, roles + who)

    for word in map("".join, itertools.product("suaX-", repeat=3)):
        assert repair.repaired(word) == min(ways(word)), word


def test_repair_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run_repair(spark, rows) == brute_repair(rows)


@pytest.mark.parametrize("piece_rows", [5, 1024])
def test_repair_of_a_conversation_over_many_partitions(spark, piece_rows):
    random.seed(3)
    texts = ["hi.", "yes", "no?", " ", None, "", "Longer text. "]
    rows = [(1, None if random.random() < 0.05 else i // 3, random.choice(["user", "assistant", "system", "tool", None, "", "user"]), random.choice([*texts, f"word {i}.", f"w{i}"])) for i in range(1500)]
    rows += [(random.choice([2, 3, None, 4]), random.randint(0, 9), random.choice(["user", "assistant", "s"]), f"t{i}.") for i in range(60)]
    rows += [(9, 5, "user", "same.")] * 400 + [(10, None, None, None), (11, 2**40, "user", "ﬀ漢字🙂!\x1c"), (11, -5, "assistant", "x" * 50_000 + ".")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run_repair(spark, rows, piece_rows=piece_rows) == brute_repair(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_nothing(spark):
    assert run_repair(spark, []) == {}
    lost = next((c, t) for c in range(50) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert run_repair(spark, [(*lost, "user", "hello.")]) == {lost[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


# --- divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, item long, value string"
ODD = [None, "", " \n ", "one", "a b c d", "ﬀ ß İ 漢字 🙂", "Été été ÉTÉ", "x" * 3000, "word " * 5000, "Tab\tNUL\x00end", "a-b_c9d"]


def audited(spark, df):
    return df.toPandas().sort_values(["lang", "source", "part", "rank"]).reset_index(drop=True)


def against_sql(spark, rows):
    df = spark.createDataFrame([(i, t, lang, source, 1, "t", 2, "v") for i, (t, lang, source) in enumerate(rows)], DOCS).repartition(3)
    got = audited(spark, divergence.audit(df, Scratch(spark, "t")))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["doc_id", "text", "lang", "source"]).astype({"text": object}))
    want = con.sql(queries.ORACLES["op12_divergence"]).df().sort_values(["lang", "source", "part", "rank"]).reset_index(drop=True)
    assert got[want.columns].astype(str).values.tolist() == want.astype(str).values.tolist()
    return got


def test_divergence_against_sql(spark):
    random.seed(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "ß", "W", "漢字"]
    rows = [(" ".join(random.choices(words, k=random.randint(0, 30))), random.choice(["en", "fr", None]), random.choice(["a", "b", "ß", None, "z"])) for _ in range(200)]
    rows += [(t, "en", "a") for t in ODD] * 3 + [("only here", "xx", "a"), (None, "xx", "b"), ("same same", "en", "hot")] + [("same Same sAme", "en", "hot")] * 60
    got = against_sql(spark, rows)
    assert set(got["part"]) == {"pair", "term"} and (got[(got.lang == "xx")].value == 0).all() and len(got[got.lang == "xx"]) == 2


def test_divergence_of_nothing(spark):
    assert audited(spark, divergence.audit(spark.createDataFrame([], DOCS), Scratch(spark, "t"))).empty
    assert against_sql(spark, [("few words", "en", "a")]).empty


def test_largest_refines_values_and_ties(spark):
    random.seed(5)
    rows = [(g, random.choice(["", "pre", "prefixprefixprefix"]) + f"{i:05d}" + random.choice(["", "é"]), random.choice([0, 5, 70_000, 70_000, 2**40, 2**40 + 1])) for g in range(4) for i in range(50 if g else 3000)]
    rows += [(9, "only", 3)]
    df = spark.createDataFrame(rows, "g int, item string, value long").repartition(4)
    got = {(r.g, r["rank"]): (r.item, r.value) for r in divergence.largest(df, ["g"], 7, Scratch(spark, "t")).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:7]
        want |= {(g, k): r[1:] for k, r in enumerate(own, 1)}
    assert got == want


def test_terms_by_bytes():
    import pyarrow as pa

    texts = [*ODD, "ends here", "Begins", "é", "é", "12 34"]
    terms, doc = divergence._terms(pa.array(texts))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [(i, m.translate(lower)) for i, t in enumerate(texts) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    assert list(zip(doc.tolist(), terms.to_pylist())) == want


# --- packing


def packed(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "piece", 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int, part int").repartition(3)
    return packing.best_fit(df, Scratch(spark, "t"), queries.word_vocabulary()).toPandas()


def in_place(out, capacity=4096):
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= capacity


def test_packing_against_the_library(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.word_vocabulary())
    model.encode_special_tokens = True
    texts = [*ODD, "It's we'll İstanbul ΣΑΣ <|endoftext|> a b́ ́x", "long words and more " * 3000, "x" * 20_000]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    out = packed(spark, texts).set_index(["doc_id", "piece"])
    in_place(out)
    n = 0
    for i, text in enumerate(texts):
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            row, own = out.loc[(i, k // 4096)], ids[k : k + 4096]
            assert (row.start, row.length, row.ids_crc32) == (k, len(own), zlib.crc32(own.tobytes()))
            n += 1
    assert n == len(out)
    assert out.sequence_id.nunique() == -(-out.length.sum() // 4096)


def test_packing_of_a_text_longer_than_a_slice(spark):
    import pyarrow as pa

    own, text = packing.words_of(queries.word_vocabulary()), "many words, or " * 400_000
    parts = packing._parts(pa.array([text]))
    assert len(parts) > 1 and "".join(parts.to_pylist()) == text
    ids, off = packing._encoded(own, parts, 1)
    assert np.delete(ids, off[1:] - 1).tolist() == [x for _ in range(400_000) for x in own.model.encode("many words, or", add_special_tokens=False).ids]
    assert packing._parts(pa.array(["y" * (9 << 20)])).to_pylist() == ["y" * (9 << 20)]


def test_packing_with_repeated_rows_and_of_nothing(spark):
    assert packed(spark, []).empty
    out = packed(spark, ["a b c"] * 5000 + [None] * 3, ids=[7] * 5003)
    in_place(out)
    assert len(out) == 5003 and out.sequence_id.nunique() == -(-(5000 * 4 + 3) // 4096)


def test_fullest_against_all_combinations():
    random.seed(4)
    for _ in range(300):
        counts = {n: random.randint(1, 3) for n in random.sample(range(1, 30), random.randint(1, 5))}
        room = random.randint(0, 60)
        uses = packing.fullest(counts, sorted(counts, reverse=True), room)
        sums = {sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))}
        assert all(uses[n] <= counts[n] for n in uses)
        assert sum(n * k for n, k in uses.items()) == max(s for s in sums if s <= room)


def fewest(items, capacity):
    """The least number of sequences, by trying every placement."""
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


def test_plan_uses_all_pieces_and_few_sequences():
    random.seed(6)
    over = 0
    for _ in range(150):
        items = sorted((random.randint(1, 20) for _ in range(random.randint(1, 9))), reverse=True)
        histogram = {n: items.count(n) for n in set(items)}
        steps = packing.plan(histogram, 20)
        used = {}
        for s in steps:
            assert s.times > 0 and sum(n * k for n, k in s.uses.items()) <= 20
            for n, k in s.uses.items():
                used[n] = used.get(n, 0) + k * s.times
        assert used == histogram
        over += sum(s.times for s in steps) - fewest(items, 20)
    assert over <= 3
    # repeated steps at once: the plan of a million times the corpus has no more steps than its own logarithm
    assert len(packing.plan({n: 10**12 + n for n in range(1, 4097)}, 4096)) < 4096 * 14
