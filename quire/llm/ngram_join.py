"""N-gram Jaccard join by T-occurrence search (free style: Arrow batches).

Two documents link when the Jaccard similarity of their sets of 5-word shingles
is 0.8 or more.  Documents with equal sets are one representative from the start.

1. **Order.**  A counter array over all shingles ranks them: rare ones first.
   Any fixed order gives right results; this one keeps shingles of popular
   passages out of the inverted lists unless a document holds little else.
2. **Lists.**  Two sets that link share a shingle among the first
   ``n - ceil(0.8 n) + 1`` of each.  Shingles that a count-min sketch estimates in
   one document only are left out, and so are places in the order behind which a
   set has too little left; the others make the inverted lists.
3. **Screen.**  Each set has a bitmap of twice its size, the parity of its shingles per
   bit.  Two bitmaps differ in no more bits than the sets in shingles, so pairs whose
   bitmaps differ too much cannot link and are dropped before any set is read.
4. **Search.**  A block is a set of documents indexed by their shingles; a query
   is a T-occurrence search in it (DivideSkip): the short lists are merged by a
   heap, survivors are probed by binary search in the long ones, and documents
   that reach the overlap which 0.8 asks for are linked.  Overlaps are exact but for
   shingles being compared by 64-bit hashes (equal for two different ones with a chance of 2**-64).
   Round one searches every list's smallest document among the list's others.
   Round two takes the lists whose documents are not all connected yet and
   searches those outside the first component among all the others.  Pairs that
   are connected already are not searched again, so a group of near copies costs
   one search each and never all pairs; large blocks are cut by size.
5. **Components** of the links.

Defined cases: null or empty text has no shingles and links with nothing; a text
under five words is one shingle; rows with a null doc_id get a null component and
link with nothing; equal doc_ids are told apart by their texts and share an id;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import give_back
from ..session import written
from . import hashing as H
from .components import components
from .sketch import BLOCK_SCHEMA, RepeatSketch, dense_blocks, merge_dense

WORDS = 5
NUM, DEN = 80, 100                   # similarity NUM / DEN
#: Cells of the counter array that orders shingles (4 bytes each while counting, 1 byte when used).
ORDER_BITS = 22
#: Two rows of 2**27 cells: a bitmap of 32 MB for the shingles in two documents or more.
SKETCH_BITS, SKETCH_DEPTH = 27, 2
#: Sketch of the doc_ids whose whole sets a round of searches needs.
ID_BITS = 25
#: Documents of one screening block's index, at most about.
BLOCK_ROWS = 2000
#: Shingles of one search block's index, about.
BLOCK_TOKENS = 1 << 18


def _sets(col: pa.Array, k: int, classes: np.ndarray | None = None):
    """Distinct shingles of a chunk's rows: (hashes, row bounds), each row in (class, hash) order."""
    h, bounds, _, _ = H.word_keys(col, fold=True)
    s, _, row = H.shingles(h, bounds, k)
    size = np.diff(bounds)
    few = np.flatnonzero((size > 0) & (size < k))
    if len(few):
        extra = []
        for r in few:
            acc = np.zeros(1, np.uint64)
            for w in h[bounds[r]:bounds[r + 1]]:
                acc = H.mix(acc + w)
            extra.append(acc + np.uint64(size[r]))
        s = np.concatenate([s, *extra])
        row = np.concatenate([row, few])
    cls = classes[_cell(s)] if classes is not None else np.zeros(len(s), np.uint8)
    order = np.lexsort((s, cls, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], np.searchsorted(row[new], np.arange(len(col) + 1))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def least_overlap(n):
    """Smallest intersection with which a set of n can link with any other."""
    return (NUM * n + DEN - 1) // DEN


def shingle_classes(docs: DataFrame, k: int) -> np.ndarray:
    """Rank (0 to 255, by quantiles of the counts) of every cell of the counter array over all shingles."""
    def count(batches):
        c = np.zeros(1 << ORDER_BITS, np.uint32)
        for b in batches:
            for _, col in H.text_chunks(b.column(0)):
                s, _ = _sets(col, k)
                c += np.bincount(_cell(s), minlength=1 << ORDER_BITS).astype(np.uint32)
        yield dense_blocks(c, 64)
        give_back()
    total = merge_dense(docs.select("text").mapInArrow(count, BLOCK_SCHEMA), "uint32", (1 << ORDER_BITS,))
    bounds = np.unique(np.quantile(total, np.arange(1, 256) / 256, method="higher"))
    return np.searchsorted(bounds, total, "right").astype(np.uint8)


_PREFIX = f"doc_id long, n long, d1 long, d2 long, prefix array<long>, bits binary, {BLOCK_SCHEMA}"


def parity_bitmaps(s: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Per row, the parity of its shingles in each of ``2**ceil(log2(2 n))`` bits (64 at least)."""
    n = np.diff(at)
    size = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(base[:-1], n) + (s & np.repeat(size - 1, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(where, minlength=base[-1]).astype(np.uint8) & 1, bitorder="little")
    return [packed[a // 8:b // 8].tobytes() for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) brought down to ``size`` bytes: the parity bitmap of fewer bits."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def prefixes(docs: DataFrame, k: int, classes, sketch: RepeatSketch) -> DataFrame:
    """One row per document (size, digest of the set, prefix), and each partition's sketch of the prefixes."""
    names = ["doc_id", "n", "d1", "d2", "prefix", "bits", "block", "part", "data"]

    def build(batches):
        seen, size = [], 0

        def sketched():
            s = sketch.partition_rows(seen)
            m = s.num_rows
            cols = [pa.nulls(m, pa.int64())] * 4 + [pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.binary())] + s.columns
            return pa.RecordBatch.from_arrays(cols, names)
        for b in batches:
            for first, col in H.text_chunks(b.column(1)):
                s, at = _sets(col, k, classes.value)
                n = np.diff(at)
                run1, run2 = (np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (H.mix(s), H.mix(s ^ np.uint64(0x5851F42D4C957F2D))))
                take = np.where(n > 0, n - least_overlap(n) + 1, 0)
                ends = np.concatenate([[0], np.cumsum(take)])
                pick = np.repeat(at[:-1], take) + np.arange(ends[-1]) - np.repeat(ends[:-1], take)
                p = s[pick]
                seen.append(p)
                size += len(p)
                m = len(n)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(first, m), pa.array(n.astype(np.int64)),
                    pa.array((run1[at[1:]] - run1[at[:-1]]).view(np.int64)), pa.array((run2[at[1:]] - run2[at[:-1]]).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(p.view(np.int64))),
                    pa.array(parity_bitmaps(s, at), pa.binary()),
                    pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names)
            if size > 1 << 22:
                yield sketched()
                seen.clear()
                size = 0
        yield sketched()
        seen.clear()
        give_back()
    return docs.select("doc_id", "text").mapInArrow(build, _PREFIX)


def postings(rows: DataFrame, sketch: RepeatSketch, bitmap) -> DataFrame:
    """(token, rep, n, i) of the prefix shingles that the sketch estimates in two documents or more; i is the place in the order."""
    def build(batches):
        for b in batches:
            lists = b.column(2)
            v = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy())
            hit = sketch.repeated(bitmap.value, v.view(np.uint64))
            r = np.repeat(np.arange(len(size)), size)[hit]
            i = (np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size))[hit]
            yield pa.RecordBatch.from_pydict({"token": pa.array(v[hit]), "rep": b.column(0).take(pa.array(r)),
                                              "n": b.column(1).take(pa.array(r)), "i": pa.array(i)})
    return rows.select("doc_id", "n", "prefix").mapInArrow(build, "token long, rep long, n long, i long")


def _hashed(ids: pa.Array) -> np.ndarray:
    return H.mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(rep, n, tokens) of the whole texts of the documents named by ``ids`` (column rep).

    The ids are sketched into a bitmap of fixed size, and other texts are passed over
    where they are read, so no text is shuffled.  A few documents more than asked for
    may come back; joins on ``rep`` leave them out.
    """
    sketch = RepeatSketch(ID_BITS, 2)

    def name(batches):
        for b in batches:
            h = _hashed(b.column(0))
            yield sketch.partition_rows([h, h])            # twice: every id counts as repeated
    bitmap = docs.sparkSession.sparkContext.broadcast(sketch.merge(ids.select("rep").mapInArrow(name, BLOCK_SCHEMA)))

    def build(batches):
        for b in batches:
            b = b.filter(pa.array(sketch.repeated(bitmap.value, _hashed(b.column(0)))))
            for first, col in H.text_chunks(b.column(1)):
                s, at = _sets(col, k)
                yield pa.RecordBatch.from_pydict({
                    "rep": b.column(0).slice(first, len(at) - 1), "n": pa.array(np.diff(at).astype(np.int64)),
                    "tokens": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(s.view(np.int64)))})
        give_back()
    return (docs.where("doc_id is not null").select("doc_id", "text")
                .mapInArrow(build, "rep long, n long, tokens array<long>"))


class Index:
    """Inverted lists of a block's documents, searched for T occurrences."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids, self.n = ids, np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        slot = np.repeat(np.arange(len(sets)), self.n)
        order = np.lexsort((slot, tokens))
        self.slots = slot[order]
        self.tokens, self.at = np.unique(tokens[order], return_index=True)
        self.end = np.append(self.at[1:], len(tokens))
        # (list, slot) as one sorted number, for binary probing
        self.keys = np.repeat(np.arange(len(self.tokens)), self.end - self.at) * len(sets) + self.slots

    def search(self, query: np.ndarray) -> list[tuple[int, int]]:
        """(slot, overlap) of the documents that link with the query set."""
        need = int(least_overlap(len(query)))
        i = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        i = i[self.tokens[i] == query]
        if len(i) < need or not need:
            return []
        length = self.end[i] - self.at[i]
        i = i[np.argsort(length, kind="stable")]
        # DivideSkip: the longest lists are set aside, as many as keep the threshold on the rest positive.
        aside = min(need - 1, int(need / (0.01 * np.log2(max(2, length.max())) + 1)))
        short, long = i[:len(i) - aside], i[len(i) - aside:]
        merged = heapq.merge(*(self.slots[self.at[j]:self.end[j]].tolist() for j in short))
        hits = [(s, c) for s, g in groupby(merged) if (c := sum(1 for _ in g)) >= need - aside]
        if not hits:
            return []
        slots, counts = (np.array(x) for x in zip(*hits))
        fits = (DEN * self.n[slots] >= NUM * len(query)) & (DEN * len(query) >= NUM * self.n[slots])
        slots, counts = slots[fits], counts[fits]
        if len(long) and len(slots):
            probe = long[None, :] * len(self.n) + slots[:, None]
            found = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            counts = counts + (self.keys[found] == probe).sum(axis=1)
        ok = DEN * counts >= NUM * (len(query) + self.n[slots] - counts)
        return list(zip(slots[ok].tolist(), counts[ok].tolist()))


def _search_blocks(batches):
    """Rows sorted by block, documents of the index before queries: links (a, b)."""
    block, ids, comps, sets, index = None, [], [], [], None
    for b in batches:
        cols = [b.column(i).to_pylist() for i in (0, 1, 2, 3, 4)]
        lists = b.column(5)
        off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        out = []
        for k, (key, chunk, query, i, comp) in enumerate(zip(*cols)):
            if (key, chunk) != block:
                block, ids, comps, sets, index = (key, chunk), [], [], [], None
            tokens = flat[off[k]:off[k + 1]]
            if not query:
                ids.append(i)
                comps.append(comp)
                sets.append(tokens.copy())
                continue
            if not ids:
                continue
            if index is None:
                index = Index(ids, sets)
            # one link to each component is enough
            linked = {comps[s]: ids[s] for s, _ in index.search(tokens) if comps[s] != comp}
            out += [(i, x) for x in linked.values()]
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()),
                                          "b": pa.array([x for _, x in out], pa.int64())})


def _blocks(index: DataFrame, queries: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows (block, piece, q, rep, comp): a block's index dealt by hash into pieces, its queries to every piece."""
    left = index.join(pieces, "block").select(
        "block", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int").alias("piece"), F.lit(False).alias("q"), "rep", "comp")
    right = queries.join(pieces, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("q"), "rep", "comp")
    return left.union(right)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("block", "piece").sortWithinPartitions("block", "piece", "q", "rep")


def _screen(batches):
    """Rows sorted by block, index before queries: pairs (a, ca, b, cb, n) whose bitmaps allow a link."""
    block, rows, groups, folded = None, [], None, {}
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("a", "ca", "b", "cb", "n")}
        for key, piece, query, rep, comp, n, bits in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, piece) != block:
                block, rows, groups, folded = (key, piece), [], None, {}
            if not query:
                rows.append((len(bits), rep, comp, n, bits))
                continue
            if groups is None:
                groups = {}
                for r in rows:
                    groups.setdefault(r[0], []).append(r)
                groups = {m: (np.array([r[1] for r in g]), np.array([r[2] for r in g]), np.array([r[3] for r in g]),
                              np.frombuffer(b"".join(r[4] for r in g), np.uint8).reshape(len(g), m)) for m, g in groups.items()}
            mine = np.frombuffer(bits, np.uint8)
            for m, (ids, comps, sizes, mat) in groups.items():
                width = min(m, len(bits))
                if (m, width) not in folded:
                    folded[m, width] = fold(mat, width)
                apart = np.bitwise_count(folded[m, width] ^ fold(mine, width)).sum(axis=1, dtype=np.int64)
                ok = (comps != comp) & (ids != rep) & ((DEN + NUM) * apart <= (DEN - NUM) * (sizes + n))
                ok &= DEN * np.minimum(sizes, n) >= NUM * np.maximum(sizes, n)
                for i in np.flatnonzero(ok):
                    for c, x in zip(out, (rep, comp, int(ids[i]), int(comps[i]), int(sizes[i]))):
                        out[c].append(x)
        yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in out.items()})


def screen_blocks(index: DataFrame, queries: DataFrame, bits: DataFrame) -> DataFrame:
    """Distinct pairs (a, ca, b, cb, n) of a query and a document of its block that may link."""
    pieces = index.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("pieces"))
    rows = _blocks(index, queries, pieces).join(bits, "rep").select("block", "piece", "q", "rep", "comp", "n", "bits")
    return _dealt(rows).mapInArrow(_screen, "a long, ca long, b long, cb long, n long").distinct()


def search_blocks(index: DataFrame, queries: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between each block's queries and its index.

    ``index``: (block, rep, comp, n); ``queries``: (block, rep, comp).  A block's index
    is cut into pieces of about ``BLOCK_TOKENS`` shingles.
    """
    pieces = index.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("pieces"))
    rows = (_blocks(index, queries, pieces).join(sets.select("rep", "tokens"), "rep")
            .select("block", "piece", "q", "rep", "comp", "tokens"))
    return _dealt(rows).mapInArrow(_search_blocks, "a long, b long")


def _linked(index: DataFrame, queries: DataFrame, bits: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Links between queries and documents of their blocks: screened by bitmaps, searched by whole sets."""
    pairs = written(screen_blocks(index, queries, bits), "pairs")
    asked = pairs.select(F.col("a").alias("block"), F.col("a").alias("rep"), F.col("ca").alias("comp")).distinct()
    found = pairs.select(F.col("a").alias("block"), F.col("b").alias("rep"), F.col("cb").alias("comp"), "n")
    sets = written(shingle_sets(docs, found.select("rep").union(asked.select("rep")), k), "sets")
    return written(search_blocks(found, asked, sets), "links")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    d = docs.select("doc_id", "text")
    classes = spark.sparkContext.broadcast(shingle_classes(d, words))
    sketch = RepeatSketch(SKETCH_BITS, SKETCH_DEPTH)
    rows = written(prefixes(d, words, classes, sketch), "prefixes")
    mine = rows.where("block is null")
    bitmap = spark.sparkContext.broadcast(sketch.merge(rows.where("block is not null").select("block", "part", "data")))
    some = mine.where("n > 0 and doc_id is not null")
    equal = written(some.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "equal-sets")
    # Inverted lists over the representatives, each with its smallest document.
    posts = postings(some, sketch, bitmap).join(equal.select("rep").distinct(), "rep")
    posts = written(posts, "postings")
    # The first shingle that two sets share has all they share behind it: at places i and j
    # their overlap is at most min(n - i, m - j).  A row stays if the list's smallest set allows it.
    sizes = posts.groupBy("token").agg(F.min("n").alias("least"), F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last")
    room = F.expr(f"{DEN + NUM} * (n - i) >= {NUM} * n + {NUM} * greatest(least, ({NUM} * n + {DEN - 1}) div {DEN})")
    posts = written(posts.join(sizes.select("token", "least"), "token").where(room).drop("least").distinct(), "near-postings")
    heads = (posts.groupBy("token").agg(F.min(F.struct("rep", "n", "i")).alias("head"), F.max("rep").alias("last"))
                  .where("head.rep < last").select("token", F.col("head.rep").alias("lead"), F.col("head.n").alias("m"), F.col("head.i").alias("j")))
    lists = written(posts.join(heads, "token"), "lists")
    # Round one: each list's smallest document against the others.
    fits = F.expr(f"{DEN} * least(n, m) >= {NUM} * greatest(n, m) and {DEN + NUM} * least(n - i, m - j) >= {NUM} * (n + m)")
    pairs = lists.where("rep != lead").where(fits).select(F.col("lead").alias("block"), "rep").distinct()
    bits = some.select(F.col("doc_id").alias("rep"), "n", "bits")
    pairs = pairs.select("block", "rep", F.col("rep").alias("comp"))
    leads = pairs.select("block", F.col("block").alias("rep"), F.col("block").alias("comp")).distinct()
    links = _linked(pairs, leads, bits, d, words)
    one = components(links)
    # Round two: lists whose documents are not all connected; pairs with the smallest document are done.
    rest = lists.where("rep != lead").join(one.withColumnRenamed("id", "rep"), "rep", "left")
    rest = written(rest.select("token", "rep", "n", F.coalesce("component", "rep").alias("comp")), "rest")
    same = ["size", "x", "y", "low"]
    open_lists = rest.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"),
                                           F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"),
                                           F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    open_lists = open_lists.groupBy(*same).agg(F.min("token").alias("token"))
    blocks = written(rest.join(open_lists.select("token", "low"), "token").withColumnRenamed("token", "block"), "blocks")
    more = _linked(blocks.select("block", "rep", "comp"), blocks.where("comp != low").select("block", "rep", "comp"), bits, d, words)
    label = components(links.union(more)).select(F.col("id").alias("rep"), "component")
    member = some.select("doc_id", "n", "d1", "d2").join(equal, ["n", "d1", "d2"]).join(label, "rep", "left")
    return (member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
                  .union(mine.where("n = 0 or doc_id is null").select("doc_id", "n", "doc_id")))
