"""Sharding along a Hilbert curve over document metadata (DataFrame functions only).

Each metadata dimension (language, source, text size) is quantised to
``2**bits`` steps by approximate quantiles, whole values by their counts; the curve index of the cell orders
the documents, and the order is cut into runs of equal row counts.  Documents
of one shard share narrow ranges in every dimension, so min/max statistics of
its files prune on any of them.

Scale: only (id, size, crc, cell) rows are shuffled, never texts.  A rank is
the cell's offset, plus the offset of a hash bucket inside the cell, plus the
row number inside that bucket.  So a hot source or one group of equal texts
that fills a cell is ranked by ``2**sub_bits`` tasks.  The table of cells has at
most ``2**(3 * bits)`` rows whatever the input.

Defined cases: null text counts as empty (size 8, crc 0); null metadata takes
the lowest step; a null doc_id is one more id; rows with equal keys get adjacent
slots; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BITS = 4
SUB_BITS = 8
#: Relative error of the quantiles is 1 / ACCURACY.
ACCURACY = 2000


def _quantiles(counts: list[tuple[str | None, float]], steps: int) -> list[str | None]:
    """Bounds of equal steps of the rows over the sorted values; null is the lowest."""
    counts = sorted(counts, key=lambda x: (x[0] is not None, (x[0] or "").encode()))
    total, seen, out = sum(n for _, n in counts), 0.0, []
    for value, n in counts:
        seen += n
        while len(out) < steps - 1 and seen >= total * (len(out) + 1) / steps:
            out.append(value)
    return out


def _value_bounds(counts: DataFrame, name: str, steps: int) -> list[str | None]:
    """Quantile bounds of a text column of (value, n) rows, by whole values.

    The ``ACCURACY`` most frequent values count exactly; the others, each a small
    part of a step, count by as many of them again in hash order, weighted up.
    """
    per = counts.groupBy(name).agg(F.sum("n").alias("n"))
    top = [tuple(r) for r in per.orderBy(F.desc("n"), name).limit(ACCURACY).collect()]
    if len(top) < ACCURACY:
        return _quantiles(top, steps)
    known = {v for v, _ in top}
    more = [tuple(r) for r in per.orderBy(F.xxhash64(name), name).limit(2 * ACCURACY).collect() if r[0] not in known]
    rest = per.agg(F.sum("n")).first()[0] - sum(n for _, n in top)
    weight = rest / max(1, sum(n for _, n in more))
    return _quantiles(top + [(v, n * weight) for v, n in more], steps)


def _step(value: Column, bounds: list) -> Column:
    """How many quantile bounds lie below the value; null lies below all others."""
    out = F.lit(0)
    for b in sorted(set(bounds), key=str):
        out = out + (value.isNotNull() if b is None else F.coalesce(value > F.lit(b), F.lit(False))).cast("int")
    return out


def _row_key() -> dict[str, Column]:
    """What a row's place depends on, and its text: rows that agree in it can be exchanged."""
    text = F.coalesce("text", F.lit(""))
    parts = [x for c in ("lang", "source") for x in (F.col(c), F.col(c).isNull())]
    return {"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text.cast("binary")),
            "row_hash": F.xxhash64(text, *parts)}


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Hilbert curve index of integer coordinates below ``2**bits``.

    Skilling's transform: for each bit from the top and each axis, either the
    lower bits of the first axis are inverted or those of the two axes are
    exchanged; a Gray decode follows; then the bits are interleaved.  The state
    is one array, folded over (bit, axis) steps.
    """
    d = len(coords)

    def turn(x: Column, step: Column) -> Column:
        q = F.pow(F.lit(2), F.lit(bits - 1) - F.floor(step / d)).cast("int")
        i = (step % d).cast("int")
        low = q - 1
        xi, x0 = F.get(x, i), F.get(x, F.lit(0))
        swap = x0.bitwiseXOR(xi).bitwiseAND(low)
        inverted = xi.bitwiseAND(q) != 0
        return F.transform(x, lambda v, k: F.when(
            inverted, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
            F.when((k == 0) & (i == 0), v)
            .when((k == 0) | (k == i), v.bitwiseXOR(swap)).otherwise(v)))

    def bind(value: Column, body) -> Column:
        """``body`` applied to a value that is computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def gray(x: Column) -> Column:
        # Each axis takes the running xor of the axes before it.
        return F.transform(x, lambda v, k: F.aggregate(F.slice(x, 1, k + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))

    def level(x: Column) -> Column:
        last = F.get(x, F.lit(d - 1))
        t = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]).cast("array<int>"), F.lit(0),
                        lambda a, b: F.when(last.bitwiseAND(b) != 0, a.bitwiseXOR(b - 1)).otherwise(a))
        return bind(t, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    def interleave(x: Column) -> Column:
        steps = F.array(*[F.struct(F.lit(i).alias("axis"), F.lit(1 << b).alias("bit"))
                          for b in range(bits - 1, -1, -1) for i in range(d)])
        return F.aggregate(steps, F.lit(0).cast("long"),
                           lambda a, s: a * 2 + (F.get(x, s["axis"]).bitwiseAND(s["bit"]) != 0).cast("long"))

    x = F.array(*[c.cast("int") for c in coords])
    if bits > 1:
        x = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * d - 1)), x, turn)
    return bind(bind(bind(x, gray), level), interleave)


def shard_documents(docs: DataFrame, shards: int = 24, bits: int = BITS, sub_bits: int = SUB_BITS) -> DataFrame:
    """doc_id, size, text_crc32, row_hash, copy, curve, shard, slot: every row in one of ``shards`` runs of the curve.

    ``copy`` numbers the rows that agree in doc_id, size, text_crc32 and row_hash.

    Row counts of the shards are at most one apart; slots are gapless from 0
    inside a shard and follow the curve.
    """
    key = _row_key()
    size, lang, source = key["size"], F.col("lang").cast("string"), F.col("source").cast("string")
    steps = 1 << bits
    b = docs.agg(F.percentile_approx(size, F.array(*[F.lit(i / steps) for i in range(1, steps)]), ACCURACY)).first()[0]
    counts = written(docs.groupBy(lang.alias("lang"), source.alias("source")).agg(F.count("*").alias("n")), "metadata")
    code = F.lit(0)
    for value, bounds in ((lang, _value_bounds(counts, "lang", steps)), (source, _value_bounds(counts, "source", steps)), (size, b or [])):
        code = code * steps + _step(value, bounds)
    d = docs.select("doc_id", *[c.alias(n) for n, c in key.items()], code.alias("code"),
                    F.pmod(F.xxhash64("doc_id"), F.lit(1 << sub_bits)).alias("sub"))
    sizes = d.groupBy("code", "sub").agg(F.count("*").alias("n"))
    # The curve is computed for cells, not for rows.
    coords = [F.shiftright("code", i * bits).bitwiseAND((1 << bits) - 1) for i in (2, 1, 0)]
    cells = sizes.groupBy("code").agg(F.sum("n").alias("n")).withColumn("curve", hilbert_index(coords, bits))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("code", "curve", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_at"),
                         F.sum("n").over(whole).alias("total"))
    inside = Window.partitionBy("code").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.withColumn("sub_at", F.coalesce(F.sum("n").over(inside), F.lit(0)))
                   .join(cells, "code").select("code", "sub", "curve", (F.col("cell_at") + F.col("sub_at")).alias("at"), "total"))
    order = Window.partitionBy("code", "sub").orderBy("doc_id", "text_crc32", "size")
    # Partitions of this window lie inside those of the other: no second shuffle.
    equal = Window.partitionBy("code", "sub", "doc_id", *key).orderBy("doc_id")
    ranked = d.withColumn("k", F.row_number().over(order)).withColumn("copy", F.row_number().over(equal)).join(starts, ["code", "sub"])
    ranked = ranked.withColumn("rank", F.col("at") + F.col("k") - 1)
    ranked = ranked.withColumn("shard", F.expr(f"rank * {shards} div total").cast("int"))
    return ranked.select("doc_id", *key, "copy", "curve", "shard",
                         (F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write whole documents in shard folders, each file a run of the curve.

    A row finds its place by doc_id (null too), text, metadata and its number among
    equal rows, so each row is written once.
    """
    key = _row_key()
    fixed = [c for c, t in docs.dtypes if "map<" not in t and t != "variant"]
    names = ["doc_id", *key]
    mine = docs.withColumns({f"_{n}": c for n, c in {"doc_id": F.col("doc_id"), **key}.items()})
    equal = Window.partitionBy(*[f"_{n}" for n in names]).orderBy(F.xxhash64(*fixed))
    mine = mine.withColumn("_copy", F.row_number().over(equal))
    names.append("copy")
    place = placed.select(*[F.col(n).alias(f"_at_{n}") for n in names], "shard", "slot")
    out = mine.join(place, [F.col(f"_{n}").eqNullSafe(F.col(f"_at_{n}")) for n in names])
    out = out.select(*docs.columns, "shard", "slot")
    (out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path))
