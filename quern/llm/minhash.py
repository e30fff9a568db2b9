"""MinHash near-dedup: links between documents whose shingle sets are similar.

1. One pass over the texts gives each document its set's size, the minima of
   ``bands x rows`` universal hashes (kept as one key per band and one bit per
   minimum), a parity sketch of the set and the key of its class: documents with the
   same words are one class and are compared once. A class is told by 128 bits of
   BLAKE2b of its words; its node is 64 of them, and classes that share those 64 are
   given nodes of their own.
2. A band key that several classes share is a bucket. Every class is paired with a few
   pivots of its bucket, not with all others. Pairs are dropped whose signature bits
   differ too often (five standard deviations below the threshold) or whose parities
   differ in more places than the sets may have elements apart (which is certain);
   the rest is confirmed on full shingle sets, word by word, not by hashes.
3. Connected components by large-star and small-star.
4. In buckets that still hold several components, all pairs between different
   components are compared in the same way, whatever the bucket's size: a bucket is
   dealt into parts, and each pair of parts meets under a key of its own, so that no
   task has a large bucket's pairs. That work is quadratic in the bucket's classes.
   Pairs inside one component need no work: they cannot change the result.

Texts that are compared are picked out of the corpus through a broadcast bitmap of
fixed size (``common.apart``), so only they are shuffled, at every size of the tables.

Null and empty texts and texts without words have an empty set and link with nothing.
A row without an id links with nothing and is kept. Rows that repeat an id are nodes of
their own, by their words, and ``link`` labels each by its own text. ``keep_one`` keeps
one row of each group: of the rows with the group's smallest id that of one text, and
of rows that repeat id and text (of any length) one. Other columns, whatever their
names, are carried and never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import shingles
from quern.llm.common import Scratch, apart, in_slices, mix64, random_u64, utf8
from quern.llm.components import components


@dataclass(frozen=True)
class Params:
    width: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    #: Bits of the parity sketch.
    parity: int = 1024
    #: Classes in one part of a bucket; larger buckets are dealt into several.
    part_rows: int = 4096

    @property
    def most_different_bits(self) -> int:
        n, p = self.bands * self.rows, (1 + self.percent / 100) / 2
        return int(np.ceil(n * (1 - p) + 5 * np.sqrt(n * p * (1 - p))))


class _Signer:
    def __init__(self, params: Params):
        n = params.bands * params.rows
        self.params, self.a, self.b = params, (random_u64(21, n) | np.uint64(1))[:, None], random_u64(22, n)[:, None]
        self.place = random_u64(23, n).reshape(params.bands, params.rows) | np.uint64(1)

    def minima(self, items: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 2**64 - 1, np.uint64)
        for at in range(0, len(items), 512):
            x = self.a * items[None, at : at + 512]
            x += self.b
            np.minimum(out, x.min(1), out=out)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        mixed = mix64(minima).reshape(self.place.shape) * self.place
        return mix64(mixed.sum(1, dtype=np.uint64) + np.arange(len(mixed), dtype=np.uint64)).view(np.int64)

    def bits(self, minima: np.ndarray, items: np.ndarray) -> np.ndarray:
        low = (mix64(minima) & np.uint64(1)).astype(np.uint8)
        odd = np.bincount((items % np.uint64(self.params.parity)).astype(np.int64), minlength=self.params.parity) & 1
        return np.packbits(np.concatenate((low, np.zeros(-len(low) % 64, np.uint8), odd.astype(np.uint8)))).view(np.int64)


def signatures(docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, hash, node, more, n, bits array<long>, keys array<long>``.

    hash is of the text as it stands, (node, more) is the class; node, more, bits and
    keys are null for an empty set.
    """

    def run(batches):
        signer = _Signer(params)
        for batch in in_slices(batches):
            data, off = utf8(batch.column(2))
            node, more, size, bits, keys = [], [], [], [], []
            for i in range(batch.num_rows):
                hashes, key = shingles.words_and_key(data[off[i] : off[i + 1]])
                if not len(hashes):
                    node.append(None), more.append(None), size.append(0), bits.append(None), keys.append(None)
                    continue
                items = np.unique(shingles.shingle(hashes, params.width))
                minima = signer.minima(items)
                for column, half in ((node, key[:8]), (more, key[8:])):
                    column.append(int.from_bytes(half, "little", signed=True))
                size.append(len(items)), bits.append(signer.bits(minima, items)), keys.append(signer.keys(minima))
            many = pa.list_(pa.int64())
            columns = [pa.array(x, pa.int64()) for x in (node, more, size)] + [pa.array(x, many) for x in (bits, keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "hash", "node", "more", "n", "bits", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, hash long, node long, more long, n long, bits array<long>, keys array<long>")


def one_node_a_class(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """``signed`` with nodes of their own for classes that agree in the first 64 bits of their keys only."""
    seen = signed.filter("node is not null").groupBy("node").agg(F.min("more").alias("first"), F.max("more").alias("last")).filter("first <> last")
    shared = scratch.save(seen.select("node", "first"))
    if shared.isEmpty():
        return signed
    moved = F.when(F.col("first").isNotNull() & (F.col("more") != F.col("first")), F.xxhash64("node", "more")).otherwise(F.col("node"))
    return scratch.save(signed.join(shared, "node", "left").withColumn("node", moved).drop("first").select(signed.columns))


def _alike(params: Params, a: str, b: str) -> Column:
    """Sizes, signature bits and parities allow the similarity."""
    words = -(-params.bands * params.rows // 64)

    def far(first: int, end: int) -> Column:
        return sum((F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(first, end)), F.lit(0))

    size = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * params.percent
    # sets as similar as that differ in at most this share of their sizes' sum, and each difference turns one parity
    apart = far(words, words + params.parity // 64) * (100 + params.percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - params.percent)
    return size & (far(0, words) <= params.most_different_bits) & apart


def _confirm(pairs: DataFrame, docs: DataFrame, chosen: DataFrame, repeated: bool, params: Params, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """The pairs (u, v) that are linked by their full shingle sets, as a written table.

    ``repeated`` says that rows of ``chosen`` may stand for several rows of ``docs``, of
    which one is compared.
    """
    pairs = scratch.save(pairs)
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = scratch.save(chosen.join(nodes, "node").select("node", F.col("doc_id").alias("wanted_id"), F.col("hash").alias("wanted_hash")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    maybe, _ = apart(texts, "doc_id", wanted, "wanted_id", scratch)
    if repeated:
        maybe = maybe.dropDuplicates(["doc_id", "hash"])
    # a row that repeats the id with another text is another class
    picked = maybe.join(wanted, (F.col("doc_id") == F.col("wanted_id")) & (F.col("hash") == F.col("wanted_hash"))).select("node", "text")
    picked = scratch.save(picked)

    def run(batches):
        for batch in in_slices(batches):
            (da, oa), (db, ob) = utf8(batch.column(1)), utf8(batch.column(3))
            ok = []
            for i in range(batch.num_rows):
                m, n, both = shingles.common(da[oa[i] : oa[i + 1]], db[ob[i] : ob[i + 1]], params.width)
                ok.append(100 * both >= params.percent * (m + n - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    a, b = picked.select(F.col("node").alias("u"), F.col("text").alias("ta")), picked.select(F.col("node").alias("v"), F.col("text").alias("tb"))
    rows = pairs.join(a, "u").join(b, "v").select("u", "ta", "v", "tb")
    out = scratch.save(rows.mapInArrow(run, "u long, v long, ok boolean").filter("ok").select("u", "v").distinct())
    scratch.drop(picked, wanted, pairs)
    return out


#: Orders of the classes (by node xor this); the first and last of a bucket in each are its pivots.
_ORDERS = (0, 0x5A5A5A5A5A5A5A5A, 0x3C96A5693C96A569)


def _stars(shared: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of every class with the pivots of its buckets, the smaller node first."""
    keyed = [F.col("node").bitwiseXOR(F.lit(x)) for x in _ORDERS]
    ends = [f(k).bitwiseXOR(F.lit(x)) for k, x in zip(keyed, _ORDERS) for f in (F.min, F.max)]
    pivots = shared.groupBy("bucket").agg(F.array(*ends).alias("pivots"))
    pairs = shared.join(pivots, "bucket").select("node", F.explode(F.array_distinct("pivots")).alias("v")).filter("node <> v")
    return pairs.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()


def _buckets(shared: DataFrame, held: DataFrame, params: Params) -> DataFrame:
    """``bucket, one, two, part, node, c, n, bits`` of buckets with several components: a row for each pair of parts that has its own.

    Two classes of different parts meet in the one cell of their parts, two of one part
    in the cell (part, part).
    """
    rows = shared.join(held.select("node", "c"), "node")
    size = rows.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).filter("c0 <> c1").select("bucket", F.ceil(F.col("m") / params.part_rows).cast("int").alias("parts"))
    live = rows.join(size, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = live.select("bucket", "node", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return cells.select("bucket", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "node").join(held.select("node", "c", "n", "bits"), "node")


def _labels(docs: DataFrame, scratch: Scratch, params: Params, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, hash, root, n_shingles, component_id, kept`` for every row."""
    signed = one_node_a_class(scratch.save(signatures(docs, params, id_col, text_col)), scratch)
    real = signed.filter("node is not null and doc_id is not null")
    first = F.min(F.struct("doc_id", "hash")).alias("x")
    chosen = scratch.save(real.groupBy("node").agg(first).select("node", "x.doc_id", "x.hash"))
    # one row of bands for each class; rows that repeat both id and text would bring it several times
    classes = scratch.save(real.join(chosen, ["node", "doc_id", "hash"]).select("node", "n", "bits", "keys"))
    repeated = classes.count() > chosen.count()
    if repeated:
        classes = scratch.save(classes.dropDuplicates(["node"]))
    single = classes.select("node", F.explode(F.array_distinct("keys")).alias("bucket"))
    pivots = single.groupBy("bucket").agg(F.min("node").alias("v"), F.max("node").alias("w")).filter("v <> w").select("bucket")
    shared = scratch.save(single.join(pivots, "bucket").select("bucket", "node"))  # buckets of several classes
    stars = _stars(shared)
    marks = classes.select("node", "n", "bits")
    near = stars.join(marks.select(F.col("node").alias("u"), F.struct("n", "bits").alias("a")), "u").join(marks.select(F.col("node").alias("v"), F.struct("n", "bits").alias("b")), "v")
    links = _confirm(near.filter(_alike(params, "a", "b")).select("u", "v").distinct(), docs, chosen, repeated, params, scratch, id_col, text_col)
    roots = scratch.save(components(links, scratch))

    held = classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("c"), "n", "bits")
    rows = _buckets(shared, held, params)
    a, b = rows.alias("a"), rows.alias("b")
    rest = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.one") == F.col("b.one")) & (F.col("a.two") == F.col("b.two")) & (F.col("a.node") < F.col("b.node")) & ((F.col("a.part") != F.col("b.part")) | (F.col("a.one") == F.col("a.two"))) & (F.col("a.c") != F.col("b.c")) & _alike(params, "a", "b"))
    more = _confirm(rest.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct(), docs, chosen, repeated, params, scratch, id_col, text_col)
    roots = scratch.save(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), scratch))

    scratch.drop(shared, classes)
    whole = chosen.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    named = whole.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = whole.select("node", "root").join(named, "root").select("node", "root", "component_id")
    slim = signed.select("doc_id", "hash", "node", "n")
    # documents without a class stay out of the join: they would all have the same key
    out = slim.filter("node is not null").join(labels, "node", "left").unionByName(slim.filter("node is null"), allowMissingColumns=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "hash", "root", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def link(docs: DataFrame, scratch: Scratch, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    return _labels(docs, scratch, params, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, scratch: Scratch, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, and every row without an id."""
    labels = _labels(docs, scratch, params, id_col, text_col).filter("doc_id is not null")
    texts = scratch.save(labels.groupBy("doc_id", "hash", "root", "kept").agg(F.count("*").alias("m")))
    # an id with several texts in its group keeps one of them
    several = texts.filter("kept and root is not null").groupBy("doc_id", "root").agg(F.min("hash").alias("h0"), F.max("hash").alias("h1")).filter("h0 <> h1").select("doc_id", "root", "h0")
    marked = texts.join(several, ["doc_id", "root"], "left")
    gone = ~F.col("kept") | (F.col("h0").isNotNull() & (F.col("hash") != F.col("h0")))
    marks = scratch.save(marked.withColumn("gone", gone).filter("gone or m > 1").select(F.col("doc_id").alias("_gone"), F.col("hash").alias("_mark"), F.when(F.col("gone"), 0).otherwise(1).alias("_stay")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    same = (F.col("_id") == F.col("_gone")) & (F.col("_hash") == F.col("_mark"))
    maybe, sure = apart(row, "_id", marks, "_gone", scratch)
    kept = sure.select("_row").unionByName(maybe.join(marks, same, "left_anti").select("_row"))
    # of the rows that repeat id and text, the one with the least hash
    repeats = marks.filter("_stay = 1")
    if repeats.isEmpty():
        return kept.select("_row.*")
    once = maybe.join(repeats, same).groupBy("_id", "_hash").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")
    return kept.unionByName(once).select("_row.*")
