"""Byte-level BPE training (VOC3, VOC4, VOC5, SRT3): planned merges, checked exactly.

**Words.**  The distinct pre-tokens with their counts lie in a table of blocks: the symbols of
many words in one array, ``SEP`` before each.  Merging is array work in Arrow batches.

**Pairs.**  The driver keeps the counts of adjacent pairs, by deltas: ``PAIRS_KEPT`` of them, those with
the largest counts, and the largest count it left out (``floor``).  A pair that is left out can only lose
counts, so the table decides as long as its best count is above the floor; else it is counted anew.

**Rounds.**  One job for many merges.  The pairs that rank first now are the *plan*.  Every task
merges the plan step by step in the words that hold such pairs, and returns by how much each step changes
each pair's count.  With the sums over the tasks the driver knows the exact counts after every step, so it takes
the plan as far as each next pair really ranks first (count, then smaller ids), and the rest is
planned again; what the rest changed makes the next plan better.  The result is that of merging one
pair at a time.

A task scans its symbols for planned pairs and links only the words that hold one (``_concerned``).

**State.**  Every ``REBASE`` rounds, with many words also after ``REBASE_MERGES`` merges, the blocks with all merges
done are written to the state folder, then the model so far.  Training that was ended goes on from the last complete state there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources.tokens import model_from_table, model_table
from .bpe import BpeModel, byte_alphabet, byte_level_words

SEP = 65535                      # before each word in a block; no symbol has this id
#: Pairs whose counts the driver keeps, at most; merges planned for a round, at least and at most.
PAIRS_KEPT, PLAN = 1 << 18, (32, 256)
#: Rounds between written states, at most; with many words the merges since the last state are as many at most.
REBASE, REBASE_MERGES, MANY_WORDS = 32, 256, 1_000_000
#: Distinct words of a task (some milliseconds of work a round); symbols of a block, about.
WORDS_PER_TASK, BLOCK_SYMBOLS = 50_000, 1 << 21
_BLOCK = "symbols binary, counts binary"


# ---------------------------------------------------------------- arrays of words
def _code(left, right):
    return left.astype(np.int64) << 32 | right.astype(np.int64)


def _block(symbols: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"symbols": pa.array([symbols.astype("<u2").tobytes()], pa.binary()),
                                       "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary())})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for s, c in zip(b.column(0), b.column(1)):
            yield np.frombuffer(s.as_buffer(), "<u2").astype(np.int32), np.frombuffer(c.as_buffer(), "<i8")


def _joined(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small blocks as blocks of about ``BLOCK_SYMBOLS``: what a step costs is paid per block."""
    kept, size = [], 0
    for block in blocks:
        if kept and size + len(block[0]) > BLOCK_SYMBOLS:
            yield tuple(map(np.concatenate, zip(*kept)))
            kept, size = [], 0
        kept.append(block)
        size += len(block[0])
    if kept:
        yield tuple(map(np.concatenate, zip(*kept)))


def _longer(symbols: np.ndarray, counts: np.ndarray):
    """The words of two symbols and more; the others can have no pair."""
    starts = np.flatnonzero(symbols == SEP)
    keep = np.diff(np.append(starts, len(symbols))) > 2
    return symbols[np.repeat(keep, np.diff(np.append(starts, len(symbols))))], counts[keep]


def _first_blocks(ids: dict[int, int]):
    """Words and counts as blocks of symbols."""
    table = np.zeros(256, np.int32)
    table[list(ids)] = list(ids.values())

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            words = b.column(0).cast(pa.large_binary())
            off = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
            data = np.frombuffer(words.buffers()[2], np.uint8)[off[0]:off[-1]]
            symbols = np.full(len(data) + len(words), SEP, np.int32)
            at = np.arange(len(data)) + np.repeat(np.arange(1, len(words) + 1), np.diff(off))
            symbols[at] = table[data]
            symbols, counts = _longer(symbols, b.column(1).to_numpy(zero_copy_only=False))
            if len(counts):
                yield symbols, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _joined(parts(batches)):
            yield _block(*block)
    return run


def _summed(codes: np.ndarray, values: np.ndarray):
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], values[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(values, first) if len(first) else values


def _concerned(symbols: np.ndarray, counts: np.ndarray, merges: list[tuple[int, int, int]]):
    """Of a block, whether each word holds a pair of ``merges``; the symbols and counts of those that do.

    The first merge that changes a word is of two symbols it has now, so the others stay as they are."""
    left, right = np.zeros(SEP + 1, bool), np.zeros(SEP + 1, bool)
    left[[m[0] for m in merges]] = True
    right[[m[1] for m in merges]] = True
    at = np.flatnonzero(left[symbols[:-1]] & right[symbols[1:]])
    known = np.unique(np.array([m[0] << 32 | m[1] for m in merges], np.int64))
    codes = _code(symbols[at], symbols[at + 1])
    k = np.searchsorted(known, codes)
    k[k == len(known)] = 0
    at = at[known[k] == codes] if len(known) else at[:0]
    starts = np.flatnonzero(symbols == SEP)
    hit = np.zeros(len(starts), bool)
    hit[np.searchsorted(starts, at, "right") - 1] = True
    return hit, symbols[np.repeat(hit, np.diff(np.append(starts, len(symbols))))], counts[hit]


class _Words:
    """A block as a linked list, with the places of the pairs that are to be merged.

    ``after`` and ``before`` link the places of living symbols; a merge writes its symbol to
    the left place and unlinks the right one.  ``places`` maps the pairs of ``merges`` to where they
    stand or stood, so a merge looks at its own places only."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, merges: list[tuple[int, int, int]]):
        word = np.cumsum(symbols == SEP) - 1
        self.s, self.weight = np.append(symbols, SEP), np.append(counts[word], 0)
        self.after, self.before = np.arange(1, len(self.s) + 1), np.arange(-1, len(self.s) - 1)
        self.codes = np.unique(np.array([m[0] << 32 | m[1] for m in merges], np.int64))
        left, right = np.zeros(SEP + 1, bool), np.zeros(SEP + 1, bool)
        left[[m[0] for m in merges]] = True
        right[[m[1] for m in merges]] = True
        self.places: dict[int, list[np.ndarray]] = {}
        self._note(np.flatnonzero(left[symbols[:-1]] & right[symbols[1:]]))

    def _note(self, at: np.ndarray) -> None:
        """Keep the places ``at`` of pairs that are to be merged."""
        codes = _code(self.s[at], self.s[self.after[at]])
        k = np.searchsorted(self.codes, codes)
        k[k == len(self.codes)] = 0
        mine = self.codes[k] == codes if len(self.codes) else np.zeros(len(codes), bool)
        at, k = at[mine], k[mine]
        order = np.argsort(k, kind="stable")
        at, k = at[order], k[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else []
        for i, part in zip(first, np.split(at, first[1:]) if len(first) else []):
            self.places.setdefault(int(self.codes[k[i]]), []).append(part)

    def _pairs(self, at: np.ndarray):
        """(places, codes, weights) of the pairs that begin at ``at`` and lie inside a word."""
        x, y = self.s[at], self.s[self.after[at]]
        inside = (x != SEP) & (y != SEP)
        return at[inside], _code(x[inside], y[inside]), self.weight[at[inside]]

    def merge(self, left: int, right: int, out: int, deltas: bool = False):
        """All (left, right) become ``out``, from left to right without overlap; with ``deltas`` the
        (codes, changes) of the pairs' counts."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        found = self.places.pop(left << 32 | right, None)
        if found is None:
            return none
        hit = found[0]
        if len(found) > 1:
            hit = np.sort(np.concatenate(found))
            hit = hit[np.append(True, hit[1:] != hit[:-1])]
        hit = hit[self.s[hit] == left]
        hit = hit[self.s[self.after[hit]] == right]
        if left == right and len(hit) > 1:
            run = np.append(True, self.after[hit[:-1]] != hit[1:])
            inside = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            hit = hit[inside % 2 == 0]
        if not len(hit):
            return none
        gone = self.after[hit]
        # Hits may be neighbours; then the place before one is the end of the other.
        if deltas:
            front = self.before[hit]
            _, lost, minus = self._pairs(np.concatenate([front[np.append(True, front[1:] != gone[:-1])], hit, gone]))
        behind = self.after[gone]
        self.s[hit], self.s[gone] = out, -1
        self.after[hit] = behind
        self.before[behind] = hit
        front = self.before[hit]
        at, won, plus = self._pairs(np.concatenate([front[np.append(True, front[1:] != hit[:-1])], hit]))
        self._note(at)
        if not deltas:
            return none
        codes, change = _summed(np.concatenate([lost, won]), np.concatenate([-minus, plus]))
        return codes[change != 0], change[change != 0]

    def alive(self) -> np.ndarray:
        """The symbols now, SEP before each word."""
        return self.s[:-1][self.s[:-1] >= 0]


def _apply(done: list[tuple[int, int, int]]):
    """Blocks with the merges ``done``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _joined(merged(batches)):
            yield _block(*block)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for symbols, counts in _joined(_blocks(batches)):
            hit, mine, weight = _concerned(symbols, counts, done)
            words = _Words(mine, weight, done)
            for m in done:
                words.merge(*m)
            changed = _longer(words.alive(), weight)
            rest = symbols[np.repeat(~hit, np.diff(np.append(np.flatnonzero(symbols == SEP), len(symbols))))], counts[~hit]
            for part in (changed, rest):
                if len(part[1]):
                    yield part
    return run


def _try(done: list[tuple[int, int, int]], plan: list[tuple[int, int, int]]):
    """Changes of the pairs' counts at each step of the plan, after the merges ``done``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, counts in _joined(_blocks(batches)):
            _, symbols, counts = _concerned(symbols, counts, done + plan)
            words = _Words(symbols, counts, done + plan)
            for m in done:
                words.merge(*m)
            found = [words.merge(*m, deltas=True) for m in plan]
            size = [len(c) for c, _ in found]
            yield pa.RecordBatch.from_pydict({
                "step": pa.array(np.repeat(np.arange(len(plan), dtype=np.int32), size)),
                "code": pa.array(np.concatenate([c for c, _ in found])), "delta": pa.array(np.concatenate([d for _, d in found]))})
    return run


def _count(done: list[tuple[int, int, int]]):
    """(code, count) of all pairs of a block after the merges ``done``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, counts in _joined(_blocks(batches)):
            words = _Words(symbols, counts, done)
            for m in done:
                words.merge(*m)
            _, codes, weight = words._pairs(np.flatnonzero(words.s[:-1] >= 0))
            codes, total = _summed(codes, weight)
            yield pa.RecordBatch.from_pydict({"code": pa.array(codes), "count": pa.array(total)})
    return run


# ---------------------------------------------------------------- the driver's table of pairs
class PairTable:
    """Counts of the pairs above ``floor``, sorted by code, so that ties rank by ids."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, floor: int):
        order = np.argsort(codes)
        self.codes, self.counts, self.floor = codes[order], counts[order].copy(), floor

    def best(self, n: int) -> list[tuple[tuple[int, int], int]]:
        """The first pairs by count, then ids, and their counts, as far as the table can tell."""
        n = min(n, len(self.counts))
        if not n:
            return []
        least = max(np.partition(self.counts, len(self.counts) - n)[len(self.counts) - n], self.floor + 1, 1)
        at = np.flatnonzero(self.counts >= least)
        at = at[np.lexsort((self.codes[at], -self.counts[at]))][:n]
        return [((int(c >> 32), int(c & 0xFFFFFFFF)), int(n)) for c, n in zip(self.codes[at], self.counts[at])]

    def first(self) -> tuple[int, int] | None:
        """The pair that ranks first; None if the table cannot tell or no pair is left."""
        if not len(self.counts):
            return None
        k = int(self.counts.argmax())
        c = int(self.codes[k])
        return (c >> 32, c & 0xFFFFFFFF) if self.counts[k] > max(self.floor, 0) else None

    def make_room(self, codes: np.ndarray, new_from: int) -> None:
        """Places (count 0) for pairs with a symbol from ``new_from`` on; others that are not here are below the floor."""
        codes = np.unique(codes)
        codes = codes[((codes >> 32) >= new_from) | ((codes & 0xFFFFFFFF) >= new_from)]
        codes = codes[~np.isin(codes, self.codes, assume_unique=True)]
        at = np.searchsorted(self.codes, codes)
        self.codes, self.counts = np.insert(self.codes, at, codes), np.insert(self.counts, at, 0)

    def add(self, codes: np.ndarray, change: np.ndarray) -> None:
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        self.counts[at[known]] += change[known]

    def shrink(self, most: int) -> None:
        alive = self.counts > 0
        if alive.sum() > most:
            cut = int(np.partition(self.counts, len(self.counts) - most // 2)[len(self.counts) - most // 2])
            alive &= self.counts > cut
            self.floor = max(self.floor, cut)
        self.codes, self.counts = self.codes[alive], self.counts[alive]


# ---------------------------------------------------------------- training
@dataclass
class Trainer:
    """One training run; ``model`` grows, ``blocks`` with the merges ``done`` are its words."""
    spark: SparkSession
    folder: str
    model: BpeModel
    vocab_size: int
    pairs_kept: int = PAIRS_KEPT
    max_merges: int = 1 << 62

    def __post_init__(self):
        self.blocks: DataFrame | None = None
        self.cached: DataFrame | None = None
        self.done: list[tuple[int, int, int]] = []
        self.many = False               # whether the blocks hold MANY_WORDS
        self.index = self.model.token_index()
        self.table: PairTable | None = None
        self.size = PLAN[0]
        self.guess: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def _room(self) -> int:
        """Merges to come, at most."""
        return min(self.vocab_size - len(self.model.specials) - len(self.index), self.max_merges - len(self.model.merges))

    def _recount(self) -> None:
        pairs = (self.blocks.mapInArrow(_count(self.done), "code long, count long").groupBy("code").agg(F.sum("count").alias("count"))
                            .orderBy(F.desc("count"), "code").limit(self.pairs_kept + 1)).toArrow()
        codes, counts = (pairs.column(c).to_numpy() for c in ("code", "count"))
        floor = int(counts[-1]) if len(counts) > self.pairs_kept else 0
        self.table = PairTable(codes[:self.pairs_kept], counts[:self.pairs_kept], floor)

    def _plan(self) -> list[tuple[int, int, int]]:
        """Merges with their ids, as merging them one by one would probably go: the pairs that rank first, each
        followed by the changes it made when it was last tried."""
        counts = {p: c for p, c in self.table.best(2 * self.size)}
        if not counts:
            return []
        heap, least = [(-c, p) for p, c in counts.items()], min(counts.values())
        heapq.heapify(heap)
        plan, made, done = [], {}, set()
        room = min(self.size, self._room())
        while heap and len(plan) < room:
            c, (l, r) = heapq.heappop(heap)
            if counts[l, r] != -c or (l, r) in done or -c < least:
                continue
            new = len(self.model.tokens) + len(made)
            token = self._token(l, made) + self._token(r, made)
            out = self.index.get(token, next((k for k, t in made.items() if t == token), None))
            if out is None:
                made[new] = token
            plan.append((l, r, new if out is None else out))
            done.add((l, r))
            if out is not None:
                if self.table.floor:
                    break           # pairs of an older symbol grow, some of them unknown here
                continue
            for x, y, change in self.guess.get((l, r), ()):
                pair = (new if x < 0 else x, new if y < 0 else y)
                if pair in counts or x < 0 or y < 0:
                    counts[pair] = counts.get(pair, 0) + change
                    if counts[pair] >= least:
                        heapq.heappush(heap, (-counts[pair], pair))
        return plan

    def _token(self, symbol: int, made: dict[int, bytes]) -> bytes:
        return made[symbol] if symbol in made else self.model.tokens[symbol]

    def _remember(self, plan: list[tuple[int, int, int]], taken: int, steps) -> None:
        """Changes of the steps that were tried in vain, for the next plan; -1 is the symbol of the step itself."""
        known, self.guess = len(self.model.tokens), {}
        for k in range(taken, len(plan)):
            l, r, out = plan[k]
            if l < known and r < known and out >= known:
                codes, change = steps(k)
                x, y = codes >> 32, codes & 0xFFFFFFFF
                fit = ((x < known) | (x == out)) & ((y < known) | (y == out))
                x, y = np.where(x == out, -1, x)[fit], np.where(y == out, -1, y)[fit]
                self.guess[l, r] = list(zip(x.tolist(), y.tolist(), change[fit].tolist()))

    def round(self) -> bool:
        """Some merges more; False when no pair is left."""
        if self.table is None or self.table.first() is None:
            self._recount()
            if self.table.first() is None:
                if not self.table.floor:
                    return False
                # every kept pair ties with one left out: the table is too small to decide
                self.pairs_kept *= 2
                return True
        plan = self._plan()
        new_from = len(self.model.tokens)
        deltas = (self.blocks.mapInArrow(_try(self.done, plan), "step int, code long, delta long")
                             .groupBy("step", "code").agg(F.sum("delta").alias("delta"))).toArrow()
        step, codes, change = (deltas.column(c).to_numpy() for c in ("step", "code", "delta"))
        self.table.make_room(codes, new_from if self.table.floor else 0)
        order = np.argsort(step, kind="stable")
        ends = np.searchsorted(step[order], np.arange(len(plan) + 1))

        def steps(k):
            at = order[ends[k]:ends[k + 1]]
            return codes[at], change[at]
        taken = 0
        for k, (l, r, out) in enumerate(plan):
            if self.table.first() != (l, r):
                break
            self.model.counts.append(int(self.table.counts.max()))
            self.table.add(*steps(k))
            if out == len(self.model.tokens):
                self.model.tokens.append(self.model.tokens[l] + self.model.tokens[r])
                self.index[self.model.tokens[out]] = out
            elif self.table.floor:
                self.table = None           # pairs that are left out may have grown
            self.model.merges.append((l, r, out))
            taken += 1
            if self.table is None:
                break
        self.done += plan[:taken]
        self._remember(plan, taken, steps)
        if self.table is not None:
            self.table.shrink(self.pairs_kept)
        self.size = min(max(2 * taken, PLAN[0]), PLAN[1])
        self.model.rounds += 1
        return True

    def save(self) -> None:
        """Blocks with all merges done, then the model: a state is complete once its model is there."""
        at = f"{self.folder}/round-{self.model.rounds:06d}"
        blocks = self.blocks.mapInArrow(_apply(self.done), _BLOCK) if self.done else self.blocks
        blocks.write.mode("overwrite").parquet(f"{at}/words")
        model_table(self.model, self.spark).coalesce(1).write.mode("overwrite").parquet(f"{at}/model")
        self.read(f"{at}/words")

    def read(self, path: str) -> None:
        """Go on from written blocks, kept in memory where they fit."""
        if self.cached is not None:
            self.cached.unpersist()
        self.blocks = self.cached = self.spark.read.schema(_BLOCK).parquet(path).persist()
        self.done = []
        self.many = (self.blocks.agg(F.sum(F.length("counts"))).first()[0] or 0) >= 8 * MANY_WORDS

    def run(self, log=None, stop_after: int | None = None) -> BpeModel:
        while self._room() > 0 and (stop_after is None or self.model.rounds < stop_after):
            if not self.round():
                break
            if self.done and (self.model.rounds % REBASE == 0 or len(self.done) >= REBASE_MERGES and self.many):
                self.save()
            if log:
                log(self.model.rounds, len(self.model.merges), self.model.counts[-1])
        return self.model


def _states(spark: SparkSession, folder: str) -> list[str]:
    """Complete states of a folder, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [str(s.getPath().toString()) for s in fs.listStatus(path) if s.getPath().getName().startswith("round-")]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(f for f in found if fs.exists(done(f"{f}/model/_SUCCESS")))


def _start(spark: SparkSession, df: DataFrame, text_col: str, specials: list[str], folder: str, vocab_size: int) -> Trainer:
    path = f"{folder}/words"
    byte_level_words(df, text_col).write.mode("overwrite").parquet(path)
    words = spark.read.parquet(path)
    alphabet = sorted((r.akey, r.byte) for r in byte_alphabet(words).collect())   # <= 256 rows
    model = BpeModel(list(specials), [s.encode("utf-8") for s in specials])
    ids = {b: len(specials) + k for k, (_, b) in enumerate(alphabet)}
    model.tokens += [bytes([b]) for _, b in alphabet]
    blocks = words.select("word", "count").repartition(max(1, words.count() // WORDS_PER_TASK)).mapInArrow(_first_blocks(ids), _BLOCK)
    trainer = Trainer(spark, folder, model, vocab_size)
    trainer.blocks = blocks
    trainer.save()
    return trainer


def train_bpe(df: DataFrame, text_col: str = "text", vocab_size: int = C.BPE_VOCAB, specials: list[str] = C.BPE_SPECIALS,
              log=None, state: str | None = None, stop_after: int | None = None, max_merges: int | None = None) -> BpeModel:
    """VOC3/VOC4: learn a byte-level BPE vocabulary and merge list; ``model.counts`` are the merged pairs' counts.

    Ends at ``vocab_size`` entries (reserved + alphabet + merges), when no pair is left, or after
    ``max_merges`` merges when given.  ``state`` names a
    folder on shared storage: training goes on from the last complete state in it.  ``stop_after`` ends the run after
    so many rounds (to be continued)."""
    if vocab_size >= SEP:
        raise ValueError(f"a vocabulary of {SEP} entries or more does not fit the blocks' symbols")
    ensure_checkpoint_dir(df.sparkSession)
    folder = state or scratch_path(df.sparkSession, "bpe")
    # Each round is a small job whose shape never changes; re-planning it at run time
    # (AQE) costs more than it saves.  The rounds get a session of their own, so the
    # caller's settings stay as they are.
    own = df.sparkSession.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    states = _states(own, folder)
    if states:
        model = model_from_table(own.read.parquet(f"{states[-1]}/model"))
        model.rounds = int(states[-1].rsplit("-", 1)[1])
        trainer = Trainer(own, folder, model, vocab_size)
        trainer.read(f"{states[-1]}/words")
    else:
        # the word count reads the whole corpus: with the caller's settings
        trainer = _start(df.sparkSession, df, text_col, specials, folder, vocab_size)
        trainer.spark = own
        trainer.read(f"{folder}/round-000000/words")
    own.conf.set("spark.sql.shuffle.partitions", str(max(1, min(8, trainer.blocks.rdd.getNumPartitions()))))
    trainer.max_merges = 1 << 62 if max_merges is None else max_merges
    try:
        return trainer.run(log, stop_after)
    finally:
        trainer.cached.unpersist()
