"""Source divergence audit: term shares of every source against its language and the other sources.

Free style.  One pass over the texts: ``bytes.translate`` with a fixed table lowers A-Z
and blanks every separator at once, ``bytes.split`` cuts the terms, and a ``Counter`` per
document gives its counts (for frequencies) and its distinct terms (for document
frequencies).  A task adds the documents of one (lang, source) together before anything is
shuffled, so a hot source or a common term costs a task one row.

Everything after that is sparse: a row per (lang, source, term) that occurs.  A term
that a group lacks has the group's least share ``p0``, so a sum over all kept terms is

    sum over terms of g of f(p_g, p0_h)  +  sum over terms of h of f(p0_g, p_h)
    + (V - |g| - |h|) f(p0_g, p0_h)
    + sum over common terms of f(p_g, p_h) - f(p_g, p0_h) - f(p0_g, p_h) + f(p0_g, p0_h)

The first two sums need a group's shares with their multiplicities only; the last one is
added up in the tasks, in matrices of ``BLOCK`` x ``BLOCK`` sources, and leaves a task as
one row per pair.  All arithmetic is in integers.

Defined cases: null text, lang and source count as ''; a group without (kept) terms is
still listed; a lang without kept terms has pair values of 0; equal rows count once each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Documents of a language that must hold a term.
LEAST_DOCS = 3
#: Ranks of a group's terms that are reported.
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Sources of a language whose pairs are added up in one matrix.
BLOCK = 64
#: (group, term) entries that a task adds up before it hands them on; bytes of text split at once.
ENTRIES, PIECE = 200_000, 1 << 20
#: Pairs of entries handled at once; matrices that a task keeps.
PAIRS, MATRICES = 1 << 20, 64

#: Letters A-Z lowered, a-z and all bytes of non-ASCII characters kept, every other byte a space.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

_TERMS = "lang string, source string, term string, count long, docs long"
_SUMS = "lang string, l int, r int, value long"


def document_terms(text: bytes) -> Counter:
    """How often each term stands in a text; long texts are split piece by piece."""
    blanked, terms, at = text.translate(TABLE), Counter(), 0
    if len(blanked) <= PIECE:
        return Counter(blanked.split())
    while at < len(blanked):
        end = blanked.find(b" ", at + PIECE)
        end = len(blanked) if end < 0 else end
        terms.update(blanked[at:end].split())
        at = end
    return terms


class _Groups:
    """Counts of the documents of a task, by (lang, source); one row without a term per group."""

    def __init__(self):
        self.counts: dict[tuple[str, str], tuple[dict[bytes, int], Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, terms: Counter) -> None:
        counts, docs = self.counts.setdefault((lang, source), ({}, Counter()))
        before = len(counts)
        for t, n in terms.items():
            counts[t] = counts.get(t, 0) + n
        docs.update(terms.keys())
        self.size += len(counts) - before

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in self.counts.items():
            terms = [b"", *counts]
            columns = [pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *counts.values()], pa.int64()),
                       pa.array([0, *(docs[t] for t in counts)], pa.int64())]
            for i in range(0, len(terms), 20_000):
                part = [c.slice(i, 20_000) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0])), pa.array([source] * len(part[0])), *part],
                                                 ["lang", "source", "term", "count", "docs"])
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = _Groups()
    for b in batches:
        for text, lang, source in zip(*b.columns):
            groups.add(lang.as_py(), source.as_py(), document_terms(text.as_py()))
            if groups.size >= ENTRIES:
                yield from groups.flush()
    yield from groups.flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents; '' stands for the group itself."""
    d = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"),
                    *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    return d.mapInArrow(_count, _TERMS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"),
                                                                              F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Rows of the terms that ``least`` documents of the language hold, with the language's count
    (``all``) and a mark on one row of each (lang, term); the rows of the groups stay."""
    w = Window.partitionBy("lang", "term")
    k = counts.select("lang", "source", "term", "count", F.sum("docs").over(w).alias("_docs"), F.sum("count").over(w).alias("all"),
                      (F.row_number().over(w.orderBy("source")) == 1).alias("first"))
    return k.where((F.col("_docs") >= least) | (F.col("term") == "")).drop("_docs")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact for every long; null where total is 0."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1) + _div(wide, F.nullif(total, F.lit(0)).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def group_shares(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``kept`` with shares p (group), q (language) and its group's number; and the groups:
    (lang, source, idx, block, terms, kinds, p0), kinds being the language's kept terms."""
    term = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(F.sum(F.when(term, F.col("count")).otherwise(0)).alias("n"),
                                                F.count(F.when(term, 1)).alias("terms"))
    langs = (kept.groupBy("lang").agg(F.count(F.when(term & F.col("first"), 1)).alias("kinds"),
                                      F.sum(F.when(term & F.col("first"), F.col("all")).otherwise(0)).alias("lang_n")))
    groups = (groups.join(langs, "lang")
                    .withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
                    .withColumn("block", _div(F.col("idx"), F.lit(BLOCK)).cast("int"))
                    .withColumn("p0", share(F.lit(0).cast("long"), F.col("n") + F.col("kinds"))))
    groups = written(groups, "source-groups")
    terms = (kept.where(term).join(groups, ["lang", "source"])
                 .select("lang", "source", "term", "idx", "block", "p0", share(F.col("count"), F.col("n") + F.col("kinds")).alias("p"),
                         share(F.col("all"), F.col("lang_n") + F.col("kinds")).alias("q")))
    return terms, groups


def top_terms(terms: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The terms of each group whose share is above the language's, the ``top`` most distant."""
    t = terms.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"),
                                                    distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return t.withColumn("rank", rank).where(F.col("rank") <= top)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Matrices:
    """Sums for pairs of sources, one matrix per (lang, block of l, block of r)."""

    def __init__(self):
        self.of: dict[tuple[str, int, int], np.ndarray] = {}

    def add(self, lang: str, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        blocks = (left // BLOCK << 32) | right // BLOCK
        for code in np.unique(blocks):
            at = slice(None) if blocks[0] == code and (blocks == code).all() else blocks == code
            m = self.of.setdefault((lang, int(code >> 32), int(code & 0xFFFFFFFF)), np.zeros((BLOCK, BLOCK), np.int64))
            np.add.at(m, (left[at] % BLOCK, right[at] % BLOCK), value[at])
        if len(self.of) > MATRICES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, lo, hi), m in self.of.items():
            l, r = np.nonzero(m)
            if len(l):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(l)), "l": pa.array(l + lo * BLOCK, pa.int32()),
                                                  "r": pa.array(r + hi * BLOCK, pa.int32()), "value": pa.array(m[l, r])})
        self.of = {}


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about ``most``."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _langs(col: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    coded = col.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, np.flatnonzero(codes == k)


def _ints(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of the terms that two sources share: rows (lang, lo, hi, array of (idx, p, p0))."""
    sums = _Matrices()
    for b in batches:
        for lang, rows in _langs(b.column(0)):
            part = b.take(pa.array(rows))
            size = _ints(part.column(3).value_lengths())
            for i, j in _slices(size * size, PAIRS):
                lists = part.column(3).slice(i, j - i)
                idx, p, p0 = (_ints(f) for f in lists.flatten().flatten())
                n, apart = size[i:j], _ints(part.column(1).slice(i, j - i)) != _ints(part.column(2).slice(i, j - i))
                row = np.repeat(np.arange(len(n)), n)
                first = (np.cumsum(n) - n)[row]
                left = np.repeat(np.arange(len(row)), n[row])
                right = np.arange(len(left)) - np.repeat(np.cumsum(n[row]) - n[row], n[row]) + first[left]
                keep = np.where(apart[row[left]], idx[left] // BLOCK != idx[right] // BLOCK, idx[left] != idx[right])
                left, right = left[keep], right[keep]
                if len(left):
                    x, y, x0, y0 = p[left], p[right], p0[left], p0[right]
                    yield from sums.add(lang, idx[left], idx[right], _f(x, y) - _f(x, y0) - _f(x0, y) + _f(x0, y0))
    yield from sums.flush()


def _margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a source's shares against the least shares of others, both ways: rows
    (lang, idx, p, times, array of (idx, p0))."""
    sums = _Matrices()
    for b in batches:
        for lang, rows in _langs(b.column(0)):
            part = b.take(pa.array(rows))
            size = _ints(part.column(4).value_lengths())
            for i, j in _slices(size, PAIRS):
                other, q0 = (_ints(f) for f in part.column(4).slice(i, j - i).flatten().flatten())
                idx, p, times = (np.repeat(_ints(part.column(c).slice(i, j - i)), size[i:j]) for c in (1, 2, 3))
                k = idx != other
                yield from sums.add(lang, idx[k], other[k], times[k] * _f(p[k], q0[k]))
                yield from sums.add(lang, other[k], idx[k], times[k] * _f(q0[k], p[k]))
    yield from sums.flush()


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of each source against every other source of its language."""
    blocks = groups.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "p0"))).alias("sources"))
    # A term's row goes once to every block it meets; a list holds the sources of two blocks at most.
    meets = terms.join(blocks.select("lang", F.col("block").alias("other")), "lang")
    lists = (meets.groupBy("lang", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "term")
                  .agg(F.collect_list(F.struct("idx", "p", "p0")).alias("entries")).where(F.size("entries") > 1)
                  .select("lang", "lo", "hi", "entries"))
    shares = terms.groupBy("lang", "idx", "p").agg(F.count(F.lit(1)).alias("times")).join(
        blocks.select("lang", "sources"), "lang").select("lang", "idx", "p", "times", "sources")
    sums = (lists.mapInArrow(_common, _SUMS).union(shares.mapInArrow(_margins, _SUMS))
                 .groupBy("lang", "l", "r").agg(F.sum("value").alias("sum")))
    g = groups.select("lang", F.col("source"), F.col("idx").alias("l"), "kinds", F.col("terms").alias("lt"), F.col("p0").alias("lp"))
    h = groups.select("lang", F.col("source").alias("item"), F.col("idx").alias("r"), F.col("terms").alias("rt"), F.col("p0").alias("rp"))
    pairs = g.join(h, "lang").where("l <> r").join(sums, ["lang", "l", "r"], "left")
    rest = (F.col("kinds") - F.col("lt") - F.col("rt")) * distance(F.col("lp"), F.col("rp"))
    value = F.when(F.col("kinds") == 0, F.lit(0).cast("long")).otherwise(F.coalesce("sum", F.lit(0)) + rest)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", rank)


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` and ``term`` of every group."""
    kept = written(kept_terms(term_counts(docs), least), "source-terms")
    terms, groups = group_shares(kept)
    columns = [F.col(c) for c in ("lang", "source", "part", "item", "value", "rank")]
    return (source_pairs(terms, groups).withColumn("part", F.lit("pair")).select(*columns)
            .union(top_terms(terms, top).withColumn("part", F.lit("term")).select(*columns)))
