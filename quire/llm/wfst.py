"""SentencePiece encoding and decoding by a weighted finite-state transducer (free style: Arrow batches).

Three machines are compiled from a model file: the normaliser (white space to its
mark, a mark in front of the text), the pieces, and byte fallback for characters
without a piece.  Composed with an input they give a lattice: nodes are the places
between its characters, arcs are pieces or runs of byte pieces.  The encoding is
the shortest path in the tropical semiring (weights add along a path, the least path
wins), found by one forward sweep.

* Unigram models: an arc weighs minus its piece's score.
* BPE models: merging is a constraint on neighbours.  A split is the one that merging
  by score reaches exactly if each two neighbouring pieces, merged from their
  characters, stay those two pieces.  So the composed machine remembers the last
  piece; an arc weighs 0 if it may follow that piece and infinity if not, and each
  node has one path of finite weight.  Which pieces may follow one another is
  worked out when first asked and remembered.

No piece crosses the start of a white-space run or a character that no piece holds, so the
lattice falls apart there; the parts are encoded once each and remembered.

Defined cases: null text counts as empty; empty text has no ids and decodes to
empty text; characters without a piece come back from their bytes; the white-space
mark in a text decodes to a space (the library does the same); equal texts have
equal ids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import text_chunks
from ..functions.memory import WordMemory

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_INF = float("inf")


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and normaliser flags of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
        raise ValueError("only the identity normaliser with marked white space is compiled")
    if m.trainer_spec.model_type not in (UNIGRAM, BPE) or any(p.type == USER for p in m.pieces):
        raise ValueError("only unigram and BPE models without user-defined pieces are compiled")
    return {"pieces": [(p.piece, p.score, p.type) for p in m.pieces], "kind": m.trainer_spec.model_type,
            "prefix": n.add_dummy_prefix, "unknown": m.trainer_spec.unk_id}


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, model: dict):
        pieces = model["pieces"]
        self.kind, self.prefix, self.unknown = model["kind"], model["prefix"], model["unknown"]
        self.score = [s for _, s, _ in pieces]
        self.text = [p for p, _, _ in pieces]
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN
                    else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.weights: dict[tuple[int, int], float] = {}
        if self.kind == BPE:               # pieces that merging never builds have no arc
            self.id = {p: i for p, i in self.id.items() if self._merged(list(p)) == [p]}
        self.longest = max(map(len, self.id))
        # the pieces as a tree of letters: letter -> [piece or -1, the letters that go on]
        self.arcs: dict[str, list] = {}
        for p, i in self.id.items():
            node = [-1, self.arcs]
            for c in p:
                node = node[1].setdefault(c, [-1, {}])
            node[0] = i
        chars = {c for p in self.id for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            self.parts = None
        else:
            lone = "".join(c for c in "\n\t\r" if c not in chars)
            self.parts = re.compile(f"[{lone}]|{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+" if lone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.memory = WordMemory(self._encode_parts)

    # ---- normaliser

    def normalised(self, text: str) -> str:
        return (MARK if self.prefix else "") + text.replace(" ", MARK) if text else ""

    # ---- weights

    def _merged(self, symbols: list[str]) -> list[str]:
        """Best-scored merge first, the leftmost of equals: what a BPE model does to a short input."""
        while len(symbols) > 1:
            best, at = -_INF, -1
            for i in range(len(symbols) - 1):
                j = self.id.get(symbols[i] + symbols[i + 1])
                if j is not None and (at < 0 or self.score[j] > best):
                    best, at = self.score[j], i
            if at < 0:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _weight(self, last: int, piece: int) -> float:
        """Weight of an arc behind the piece ``last`` (-1: none, a byte, or a unigram model), to be remembered."""
        if self.kind == UNIGRAM:
            w = -self.score[piece]
        elif last < 0:
            w = 0.0
        else:
            a, b = self.text[last], self.text[piece]
            w = 0.0 if self._merged(list(a + b)) == [a, b] else _INF
        if len(self.weights) > 2_000_000:
            self.weights.clear()
        self.weights[last, piece] = w
        return w

    # ---- shortest path

    def path(self, part: str) -> list[int]:
        """Ids of one part: the shortest path of its lattice."""
        n = len(part)
        cost, last, back = [0.0] + [_INF] * n, [-1] * (n + 1), [0] * (n + 1)
        low = min(self.score) - 10 if self.kind == UNIGRAM else 0.0
        arcs, weight, bpe = self.arcs, self.weights.get, self.kind == BPE
        for i in range(n):
            c = cost[i]
            if c == _INF:
                continue
            before, go_on, j = last[i] if bpe else -1, arcs, i
            for letter in part[i:i + self.longest]:
                node = go_on.get(letter)
                if node is None:
                    break
                p, go_on = node
                j += 1
                if p < 0 or c >= cost[j]:
                    continue
                w = weight((before, p))
                if w is None:
                    w = self._weight(before, p)
                if c + w < cost[j]:
                    cost[j], last[j], back[j] = c + w, p, i
            if (j == i or arcs[part[i]][0] < 0) and (w := c - low + 1) < cost[i + 1]:      # byte fallback
                cost[i + 1], last[i + 1], back[i + 1] = w, -1, i
        out: list[int] = []
        at = n
        while at:
            i = back[at]
            if last[at] >= 0:
                out.append(last[at])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(part[i:at].encode())]
            else:
                out.append(self.unknown)
            at = i
        return out[::-1]

    def _encode_parts(self, parts: list[str]):
        ids = [self.path(p) for p in parts]
        return np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts, ends = [], []
        for t in texts:
            t = self.normalised(t)
            parts += self.parts.findall(t) if self.parts else [t] if t else []
            ends.append(len(parts))
        ids, end = self.memory.ids(parts)
        return [ids[end[a]:end[b]] for a, b in zip([0] + ends, ends)]

    def decode(self, ids) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_machines: dict[int, Transducer] = {}


def machine(model: dict) -> Transducer:
    """This worker's transducer of a model."""
    key = hash((model["kind"], len(model["pieces"]), tuple(model["pieces"][-100:])))
    if key not in _machines:
        _machines.clear()
        _machines[key] = Transducer(model)
    return _machines[key]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, n_ids, ids_crc32 (little-endian 32-bit), decoded_sha256 of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))        # a vocabulary file: fixed size

    def build(batches):
        t = machine(model.value)
        for b in batches:
            for first, col in text_chunks(b.column(1)):
                ids = t.encode(col.to_pylist())
                flat = np.concatenate(ids).astype("<u4") if ids else np.zeros(0, "<u4")
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column(0).slice(first, len(ids)),
                    "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int32))),
                    "n_ids": pa.array(np.diff(ends)), "ids_crc32": pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    "decoded_sha256": pa.array([hashlib.sha256(t.decode(i.tolist()).encode()).hexdigest() for i in ids], pa.string())})
    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, decoded_sha256 string")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def build(batches):
        t = machine(model.value)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array([t.decode(v.as_py() or []) for v in b.column(1)], pa.string())})
    return encoded.select("doc_id", "ids").mapInArrow(build, "doc_id long, text string")
