"""Vectorised word hashing over Arrow string batches.

Words and shingles are hashed straight from the UTF-8 buffer of an Arrow
column: no Python string is made per word.  A word's hash depends on the word's bytes
alone, so it is the same in every task and on every retry.  There are two:

* ``word_keys``, by which words are told apart: the sum, over the bytes, of a mixed
  value of the byte and its place in the word (a random number for each pair of the
  two).  Two different words have equal keys with a chance of 2**-64, however they are built.
* ``words``, cheaper, for the buckets of a model's vector table: a polynomial over
  per-byte random values, which some long alternating words share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the scratch arrays (about 40 bytes per byte).
CHUNK_BYTES = 2 << 20

_P = np.uint64(0x9E3779B97F4A7C15)      # odd multiplier of the byte polynomial
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xE7037ED1A0B428DB)   # odd; multiples of it number the places in a word
_PLACE = np.uint64(0x8EBC6AF09C88C6E3)  # odd multiplier that mixes byte and place
_Q = np.uint64(0xD6E8FEB86659FD93)      # odd multiplier of the word polynomial
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

# Separators of the contracts' word pattern [^\x20\x09-\x0D]+: six ASCII bytes.
_SEP = np.ones(256, np.uint8)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
SPACED = _SEP                            # 0 separator, 1 word byte

# Letters, digits and all non-ASCII bytes against runs of ASCII punctuation.
SHAPED = _SEP.copy()
SHAPED[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 2

_FOLD = _BYTE.copy()
_FOLD[0x41:0x5B] = _BYTE[0x61:0x7B]      # A-Z hash as a-z

_powers = {"n": 0}


def _power_tables(n: int):
    if _powers["n"] < n:
        size = 1 << n.bit_length()           # by doubling: a caller of short chunks keeps short tables
        for name, p in (("up", _P), ("down", _P_INV)):
            t = np.full(size, p, np.uint64)
            t[0] = 1
            _powers[name] = np.cumprod(t)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def text_chunks(col: pa.Array, size: int = CHUNK_BYTES):
    """Slices of a string column of about ``size`` bytes each, as (first row, array)."""
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + n + 1]
    at = 0
    while at < n:
        to = int(np.searchsorted(off, int(off[at]) + size, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, col.slice(at, to - at)
        at = to


def buffers(col: pa.Array):
    """(UTF-8 bytes, row offsets from 0) of a string array without nulls."""
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def _spans(data: np.ndarray, off: np.ndarray, classes: np.ndarray):
    """(byte starts, byte ends) of the maximal runs of bytes of one non-zero class inside one row."""
    n = len(data)
    c = classes[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(c[1:], c[:-1], out=edge[1:n])
    edge[off] = True
    inside = c != 0
    return np.flatnonzero(inside & edge[:n]), np.flatnonzero(inside & edge[1:]) + 1


def _running(v: np.ndarray) -> np.ndarray:
    out = np.empty(len(v) + 1, np.uint64)
    out[0] = 0
    np.cumsum(v, out=out[1:])
    return out


def _no_words(off: np.ndarray):
    z = np.zeros(0, np.int64)
    return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), z, z


def words(col: pa.Array, classes: np.ndarray = SPACED, fold: bool = False):
    """Hash the words of a chunk into buckets.

    Returns (hashes, row bounds into them, byte starts, byte ends): row ``r``
    owns the words ``bounds[r]:bounds[r + 1]``.  A word is a maximal run of
    bytes of one non-zero class inside one row.
    """
    data, off = buffers(col)
    n = len(data)
    if not n:
        return _no_words(off)
    s, e = _spans(data, off, classes)
    up, down = _power_tables(n + 1)
    run = _running((_FOLD if fold else _BYTE)[data] * up[:n])
    return mix((run[e] - run[s]) * down[s]), np.searchsorted(s, off), s, e


def word_keys(col: pa.Array, fold: bool = False):
    """As ``words`` over runs without white space, with hashes that tell words apart."""
    data, off = buffers(col)
    n = len(data)
    if not n:
        return _no_words(off)
    s, e = _spans(data, off, SPACED)
    place = np.zeros(n, np.int64)                # of each byte in its word, from 1
    place[s] = np.diff(s, prepend=0)
    place = np.arange(1, n + 1) - np.cumsum(place, out=place)
    v = mix(place.view(np.uint64) * _STEP)
    v ^= (_FOLD if fold else _BYTE)[data]
    v ^= v >> np.uint64(32)
    v *= _PLACE
    v ^= v >> np.uint64(29)
    run = _running(v)
    return mix(run[e] - run[s]), np.searchsorted(s, off), s, e


def row_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingles(h: np.ndarray, bounds: np.ndarray, k: int):
    """Hashes of ``k`` consecutive words of one row: (hashes, first word's index, row)."""
    n = len(h) - k + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _Q
        acc += h[j:n + j]
    row = row_of(bounds)[:n]
    at = np.flatnonzero(np.arange(k, n + k) <= bounds[row + 1])
    return mix(acc[at] + np.uint64(k)), at, row[at]
