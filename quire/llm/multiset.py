"""Homomorphic multiset fingerprints of documents (DataFrame functions only).

A document is the multiset of its paragraphs (lines, empty ones included).  A
paragraph hashes to a wide vector; a fingerprint is the sum of the vectors of
its paragraphs, each component modulo a power of two.  So the order of the
paragraphs does not matter, and inserting or deleting one is one vector
addition or subtraction.  The vector has two parts:

* ``DIGEST`` components of 32 bits from the paragraph's SHA-256, modulo 2**32:
  they decide equality.
* ``LANES`` signed components of 20 bits: every pair of neighbouring words of
  the paragraph (a lone word by itself) adds +1 or -1 to one lane.  Sums of
  random signs keep inner products, so the cosine of two lane vectors estimates
  how much of their text two documents share; unrelated texts are near 0 with a
  deviation of ``1 / sqrt(LANES)``.  Three lanes are summed in one long.

Defined cases: null text counts as empty (one empty paragraph); a null doc_id
orders first and its row comes back with a null doc_id; rows with equal doc_id
are ordered by text hash; rows equal in both count once in the order and all get
the same result; a single document is
its own next document; an empty table gives an empty result; other columns are
not read.  Documents whose paragraphs are permuted have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

DIGEST = 8
LANES = 96
_PACK = 3                     # lanes in one long, 20 bits each
_SLOTS = DIGEST + LANES // _PACK
_HALF, _MOD = 1 << 19, 1 << 20
_LOWEST = -(1 << 63)


def _contributions(paragraph: Column) -> Column:
    """array<struct<slot, v>>: what one paragraph adds to the packed vector."""
    sha = F.sha2(paragraph.cast("binary"), 256)
    digest = [F.struct(F.lit(i).alias("slot"),
                       F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long").alias("v")) for i in range(DIGEST)]
    word = F.split(F.trim(paragraph), r"[\x20\x09-\x0D]+")
    pairs = F.when(F.size(word) == 1, F.array(F.xxhash64(F.get(word, F.lit(0))))).otherwise(
        F.zip_with(F.slice(word, 1, F.greatest(F.size(word) - 1, F.lit(0))),
                   F.slice(word, 2, F.greatest(F.size(word) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    return F.concat(F.array(*digest), F.transform(pairs, _lane))


def _lane(h: Column) -> Column:
    lane = F.pmod(h, F.lit(LANES)).cast("int")
    sign = 1 - 2 * F.shiftrightunsigned(h, 63)
    unit = F.when(lane % _PACK == 0, F.lit(1)).when(lane % _PACK == 1, F.lit(_MOD)).otherwise(F.lit(_MOD * _MOD))
    return F.struct((F.expr(str(DIGEST)) + F.floor(lane / _PACK).cast("int")).alias("slot"),
                    (sign * unit.cast("long")).alias("v"))


def fingerprints(docs: DataFrame, keys: list[str], text: str, copies: Column | None = None) -> DataFrame:
    """``keys`` plus ``digest`` (array of 32-bit numbers) and ``lanes`` (array of signed counts).

    Keys must name a document, which may stand in ``copies`` equal rows; no shuffle
    happens if the input is already partitioned by one of the keys.
    """
    copies = F.lit(1) if copies is None else copies
    paragraphs = docs.select(*keys, copies.alias("w"), F.explode(F.split(F.col(text), "\n")).alias("p"))
    parts = paragraphs.select(*keys, "w", F.explode(_contributions(F.col("p"))).alias("c"))
    sums = (parts.groupBy(*keys, "w", F.col("c.slot").alias("slot")).agg(F.sum("c.v").alias("v"))
                 .withColumn("v", F.expr("v div w")))
    wide = sums.groupBy(*keys).agg(*[F.sum(F.when(F.col("slot") == i, F.col("v")).otherwise(0)).alias(f"s{i}")
                                     for i in range(_SLOTS)])
    lanes = []
    for i in range(DIGEST, _SLOTS):
        rest = F.col(f"s{i}")
        first = F.pmod(rest + _HALF, F.lit(_MOD)) - _HALF
        rest1 = F.shiftright(rest - first, 20)
        second = F.pmod(rest1 + _HALF, F.lit(_MOD)) - _HALF
        lanes += [first, second, F.shiftright(rest1 - second, 20)]
    return wide.select(*keys, F.array(*[F.col(f"s{i}") % (1 << 32) for i in range(DIGEST)]).alias("digest"),
                       F.array(*[x.cast("int") for x in lanes]).alias("lanes"))


def add(a: Column, b: Column, modulus: int = 1 << 32) -> Column:
    """Component-wise sum: the fingerprint part of the union of two multisets."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(modulus)))


def subtract(a: Column, b: Column, modulus: int = 1 << 32) -> Column:
    """Component-wise difference: paragraphs of ``b`` deleted from ``a``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(modulus)))


def as_text(digest: Column, lanes: Column) -> Column:
    """A fingerprint as lower-case hex: the digest, a colon, then the lanes modulo 2**16."""
    return F.concat(F.array_join(F.transform(digest, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(":"),
                    F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(1 << 16)))), 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two lane vectors, clipped to 0..1; 1 for two all-zero vectors, 0 if only one is."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    aa, bb = dot(a, a), dot(b, b)
    return F.when((aa == 0) & (bb == 0), F.lit(1.0)).when((aa == 0) | (bb == 0), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / F.sqrt(aa * bb))))


def next_documents(keys: DataFrame) -> DataFrame:
    """(k, h, n, copies) with the key of the row that follows in (k, h) order, the last one's being the first.

    Rows are range-partitioned; a partition's last row takes the first row of the
    next partition from a table with one row per partition.
    """
    ranked = written(keys.repartitionByRange("k", "h").withColumn("pid", F.spark_partition_id()), "doc-order")
    me = F.struct("k", "h")
    first = ranked.groupBy("pid").agg(F.min(me).alias("head"))
    w = Window.orderBy("pid")
    first = first.select("pid", F.coalesce(F.lead("head").over(w), F.min("head").over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    nxt = F.lead(me).over(Window.partitionBy("pid").orderBy("k", "h"))
    return (ranked.withColumn("nxt", nxt).join(first, "pid")
                  .withColumn("nxt", F.coalesce("nxt", "after"))
                  .select("k", "h", "n", "copies", F.col("nxt.k").alias("nk"), F.col("nxt.h").alias("nh")))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text is the text without its last quarter, followed by as many
    code points of the next document's beginning.  The texts are shuffled once
    by document and the beginnings once; fingerprints are built where the
    joined rows lie.
    """
    text = F.coalesce("text", F.lit(""))
    body = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("k"), F.xxhash64(text).alias("h"), text.alias("t"))
    keys = body.groupBy("k", "h").agg(F.max(F.length("t")).cast("long").alias("n"), F.count("*").alias("copies"))
    order = written(next_documents(keys), "doc-next")
    quarter = F.expr("n div 4").cast("int")
    # Beginning of each document, addressed to the document before it.
    before = order.select(F.col("nk").alias("k"), F.col("nh").alias("h"), F.struct("k", "h").alias("to"), quarter.alias("q"))
    heads = (body.join(before, ["k", "h"])
                 .groupBy("to").agg(F.max(F.substring(F.col("t"), F.lit(1), F.col("q"))).alias("head"))
                 .select("to.*", "head"))
    both = body.join(order, ["k", "h"]).join(heads, ["k", "h"])
    edited = F.concat(F.substring(F.col("t"), F.lit(1), F.col("n").cast("int") - quarter), F.col("head"))
    both = both.select("k", "h", "copies", F.explode(F.array(F.struct(F.lit(False).alias("e"), F.col("t").alias("x")),
                                                             F.struct(F.lit(True).alias("e"), edited.alias("x")))).alias("v"))
    both = both.select("k", "h", "copies", "v.e", "v.x")
    prints = fingerprints(both, ["k", "h", "e"], "x", F.col("copies"))
    sha = (both.where("e").withColumn("sha", F.sha2(F.col("x").cast("binary"), 256))
               .groupBy("k", "h").agg(F.max("sha").alias("edited_sha256")))
    pair = prints.groupBy("k", "h").agg(
        *[F.first(F.when(F.col("e") == e, F.col(c)), ignorenulls=True).alias(c + s)
          for e, s in ((F.lit(False), ""), (F.lit(True), "_e")) for c in ("digest", "lanes")])
    pair = written(pair.join(sha, ["k", "h"]).join(order, ["k", "h"]), "fingerprints")
    following = pair.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("lanes").alias("lanes_n"))
    out = pair.join(following, ["nk", "nh"]).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(F.when(F.col("k") != _LOWEST, F.col("k")).alias("doc_id"), F.col("n").alias("n_chars"),
                      "edited_sha256", as_text(F.col("digest"), F.col("lanes")).alias("fingerprint"),
                      as_text(F.col("digest_e"), F.col("lanes_e")).alias("edited_fingerprint"),
                      likeness(F.col("lanes"), F.col("lanes_e")).alias("near_edited"),
                      likeness(F.col("lanes"), F.col("lanes_n")).alias("near_next"))
