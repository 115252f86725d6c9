"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text (free style).

1. **Folding.**  Compatibility forms are decomposed, case, accents and invisible characters go,
   letters of other scripts that look like Latin ones become those, and digits and signs
   inside a word become the letters they stand for (``1d10t``, ``mor0n``, ``tr@sh``).  l, i and 1
   fold to one letter.  Numbers and all other characters separate words.
2. **Lexicon.**  Entries are whole words and beginnings of words; each weighs its log odds
   between toxic and other labelled documents.  An entry is kept if ``LEAST_DOCS`` toxic
   documents hold it, its weight is ``LEAST_WEIGHT`` or more and the difference is no chance
   (G-test, ``LEAST_G``).  A beginning that one longer entry explains is dropped for that one.
3. **Exceptions.**  A hit inside an exception phrase does not count: stated phrases, and words or
   word pairs around hits that labelled clean documents hold as often as toxic ones.
4. **Score.**  A word counts once, with its heaviest entry.  The weights are added up and
   normalised by length; a logistic curve over the sum, the sum per word and the length is
   fitted on labelled documents that the lexicon was not learnt from.

Learning reads labels of documents whose crc32(doc_id as text) mod 5 is not 0 (1 to 3 for the
lexicon, 4 for the curve), ``SAMPLE`` rows at most, those with the least hash of doc_id.

Defined cases: null text counts as empty; empty text is scored like any other (no hit, no
word); a null doc_id is scored and not held out; labels that are null or without a
document teach nothing; without usable labels of both classes the score is the mean label
(0 if there is none); equal texts have equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Labelled documents used for fitting, at most; entries of the lexicon and of the learnt exceptions, at most.
SAMPLE, ENTRIES = 20_000, 5_000
LEAST_DOCS, LEAST_WEIGHT, LEAST_G = 4, 2.5, 20.0
#: Clean documents that a learnt exception needs.
LEAST_CLEAN = 5
#: Letters of a whole word, at least; of a word's beginning.
WORD, BEGINNING = 3, (4, 9)
#: Letters of an entry, at most (a longer word enters with its beginnings).
LONGEST = 60
THRESHOLD = 0.5

# ---- fixed values (look-alike letters, substituted digits and signs, exception phrases) ----
LOOKALIKES = dict(zip("авекмнорстухіѕјһԁԛԝѵгпѡαβγεικνορτυχωηıłøđħŧƒɑɡɩɪʟɴʀɢ",
                      "abekmhopctyxisjhdqwvrnwabyeikvoptuxwnilodhtfagiilnrg"))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
SIGNS = {"$": "s", "@": "a", "€": "e", "£": "i"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash compactor", "clown fish", "clown car", "pond scum",
              "idiot proof", "idiot light", "stupid question", "stupid mistake", "useful idiot")

_SIGN = re.compile("(?<=[^\\W\\d_])[" + re.escape("".join(SIGNS)) + "](?=[^\\W\\d_])")
_NUMBER = re.compile(r"(?<![^\W_])\d+(?![^\W_])")


class _Fold(dict):
    """Folded form of each code point, worked out when it is first met."""

    def __missing__(self, cp: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(cp)).casefold()):
            if unicodedata.category(c) not in ("Mn", "Me", "Cf"):
                c = LOOKALIKES.get(c, c)
                c = SUBSTITUTES.get(c, c)
                out += c if c.isalnum() else " "
        self[cp] = out
        return out


_FOLD = _Fold()


def _aligned(text: str) -> str:
    """The text with numbers blanked and signs inside words replaced, code point by code point."""
    t = _NUMBER.sub(lambda m: " " * len(m[0]), text)
    return _SIGN.sub(lambda m: SIGNS[m[0]], t) if any(s in t for s in SIGNS) else t


def fold(text: str | None) -> str:
    """Folded words, joined by one space."""
    return " ".join(_aligned(text).translate(_FOLD).split()) if text else ""


def word_places(text: str) -> list[tuple[int, int]]:
    """Places (start, end) in the text of its folded words, in order."""
    folded = [c.translate(_FOLD) for c in _aligned(text)]
    at = np.repeat(np.arange(len(folded)), [len(f) for f in folded])
    return [(int(at[m.start()]), int(at[m.end() - 1]) + 1) for m in re.finditer(r"\S+", "".join(folded))]


@dataclass
class Model:
    """Entries (a leading space; whole words end with one) and their weights; exception phrases; the curve."""
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: list[float] = field(default_factory=list)
    constant: float | None = None

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for p, w in self.entries.items():
            a.add_word(p, (len(p), w))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 2, None))
        a.make_automaton()
        return a

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = x @ np.array(self.curve[:-1]) + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def hits(folded: str, a: ahocorasick.Automaton) -> dict[int, float]:
    """Where hit words begin in ' ' + folded + ' ' (the space before them), and their weights."""
    text, found, free = f" {folded} ", {}, set()
    if not len(a):
        return found
    for last, (size, weight) in a.iter(text):
        at = last - size + 1
        if weight is None:
            free.update(k for k in range(at, last) if text[k] == " ")
        elif weight > found.get(at, 0.0):
            found[at] = weight
    for at in free & found.keys():
        del found[at]
    return found


def features(text: str | None, a: ahocorasick.Automaton) -> list[float]:
    """Sum of weights, sum per hundred words, number of words; logarithms."""
    folded = fold(text)
    words = folded.count(" ") + 1 if folded else 0
    total = sum(hits(folded, a).values())
    return [math.log1p(total), math.log1p(100 * total / (words + 10)), math.log1p(words)]


def _candidates(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        if len(w) >= WORD:
            if len(w) <= LONGEST:
                out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(BEGINNING[0], min(BEGINNING[1], len(w) - 1) + 1))
    return out


def _phrases(folded: str, a: ahocorasick.Automaton) -> set[str]:
    """Hit words, alone and with the word before or behind."""
    out, words = set(), folded.split()
    starts = {}
    at = 0
    for k, w in enumerate(words):
        starts[at] = k
        at += len(w) + 1
    for at in hits(folded, a):
        k = starts[at]
        out |= {words[k], " ".join(words[max(0, k - 1):k + 1]), " ".join(words[k:k + 2])}
    return {p for p in out if len(p) <= 2 * LONGEST}


def _document_counts(rows: DataFrame, what) -> DataFrame:
    """(term, toxic, clean): labelled documents that hold each term of ``what(folded text)``; '' is every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = what(), (Counter(), Counter())

        def flush():
            terms = list(counts[0].keys() | counts[1].keys())
            for i in range(0, len(terms), 50_000):
                t = terms[i:i + 50_000]
                yield pa.RecordBatch.from_pydict({"term": pa.array(t, pa.string()), "toxic": pa.array([counts[1][x] for x in t], pa.int64()),
                                                  "clean": pa.array([counts[0][x] for x in t], pa.int64())})
            for c in counts:
                c.clear()
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1)):
                counts[y].update(of(fold(text.as_py())) | {""})
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield from flush()
        yield from flush()
    return rows.select("y", "text").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(counts: DataFrame) -> dict[str, float]:
    total = counts.where("term = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return {}
    n, m = total["toxic"], total["clean"]
    t, c = F.col("toxic"), F.col("clean")
    weight = F.log((t + 0.5) / (n + 1)) - F.log((c + 0.5) / (m + 1))
    expected = (t + c) * (n / (n + m))
    g = 2 * (t * F.log(t / expected) + F.when(c > 0, c * F.log(c / (t + c - expected))).otherwise(0))
    rows = (counts.where((F.col("term") != "") & (t >= LEAST_DOCS)).select("term", "toxic", weight.alias("w"), g.alias("g"))
                  .where((F.col("w") >= LEAST_WEIGHT) & (F.col("g") >= LEAST_G)).orderBy(F.desc("g"), "term").limit(ENTRIES).collect())
    held = {r["term"]: r["toxic"] for r in rows}
    # The longest of several entries that stand for the same documents.
    grown = Counter()
    for term, k in held.items():
        for end in range(2, len(term)):
            grown[term[:end]] = max(grown[term[:end]], k)
    return {r["term"]: r["w"] for r in rows if grown[r["term"]] < 0.9 * r["toxic"]}


def _curve(x: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> list[float]:
    """Coefficients and intercept of a logistic regression, by Newton steps on standardised columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    keep = np.append(np.ones(x.shape[1]), 0.0) * decay
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + decay * np.eye(len(b)), z.T @ (p - y) / len(y) + keep * b)
        b -= step
    return [float(v) for v in [*(b[:-1] / scale), b[-1] - (b[:-1] / scale) @ mean]]


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Lexicon, exceptions and curve from a bounded sample of labels."""
    lab = (labels.where("doc_id is not null and toxic in (0, 1)").where(_remainder(F.col("doc_id")) != 0)
                 .select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))
                 .orderBy(F.xxhash64("id"), "id", "y").limit(sample))
    # The sample has at most `sample` rows of 12 bytes.
    rows = written(docs.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("id"))
                       .select("id", "y", F.coalesce("text", F.lit("")).alias("text"), (_remainder(F.col("id")) == 4).alias("curve")), "toxic-sample")
    learn = rows.where("not curve")
    model = Model(_lexicon(_document_counts(learn, lambda: _candidates)), tuple(dict.fromkeys(fold(e) for e in exceptions)))
    if model.entries:
        first = model

        def phrases():
            a = first.automaton()
            return lambda folded: _phrases(folded, a)
        counts = _document_counts(learn, phrases)
        total = counts.where("term = ''").first()
        odds = (F.col("toxic") + 0.5) / (total["toxic"] + 1) <= (F.col("clean") + 0.5) / (total["clean"] + 1)
        learnt = counts.where((F.col("term") != "") & (F.col("clean") >= LEAST_CLEAN) & odds).orderBy(F.desc("clean"), "term").limit(ENTRIES)
        model = Model(model.entries, tuple(dict.fromkeys([*model.exceptions, *(r["term"] for r in learnt.collect())])))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for b in batches:
            x = [features(t.as_py(), a) for t in b.column(2)]
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "y": b.column(1), "x": pa.array(x, pa.list_(pa.float64()))})
    points = rows.where("curve").select("id", "y", "text").mapInArrow(measured, "id long, y int, x array<double>").collect()
    if len({r["y"] for r in points}) < 2:        # too few labels for a part of their own
        points = rows.select(F.col("id").cast("long"), "y", "text").mapInArrow(measured, "id long, y int, x array<double>").collect()
    points.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    y = np.array([r["y"] for r in points], float)
    if len(set(y)) < 2:
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    return Model(model.entries, model.exceptions, _curve(np.array([r["x"] for r in points]), y))


def scored(text: Column, model: Model) -> Column:
    """Score of a text column: probability of a toxic label, 0 to 1."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = model.automaton()
        for col in batches:
            x = np.array([features(t.as_py(), a) for t in col]).reshape(-1, 3)
            yield pa.array(model.score(x), pa.float64())
    return run(text)


def toxic_spans(text: Column, model: Model) -> Column:
    """The hit words of a text: array of (start, end, weight), places in code points of the text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    @F.arrow_udf("array<struct<start: int, end: int, weight: double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = model.automaton()
        for col in batches:
            out = []
            for t in (v.as_py() for v in col):
                folded = fold(t)
                found = hits(folded, a)
                places = word_places(t) if found else []
                out.append([{"start": places[k][0], "end": places[k][1], "weight": w}
                            for k, w in sorted((folded.count(" ", 0, at), w) for at, w in found.items())])
            yield pa.array(out, kind)
    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, sample)
    d = docs.select("doc_id", scored(F.col("text"), model).alias("score"))
    return d.select("doc_id", F.coalesce(_remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
