"""Column expressions for text: whitespace, lines, pre-tokenising, NFC, hashing.

Regular expressions are Java syntax (Spark).  The character classes are
spelled with ``\\x{..}`` escapes so the same class string is also valid RE2
(DuckDB) where the oracles need it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


# ---- fixed values: character classes and patterns ----
# Python's str.isspace() set (used by strip() and the blank-line test).
WS_CLASS = (r"[\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
NON_WS_CLASS = "[^" + WS_CLASS[1:]
# The same set as plain characters, for btrim().
WS_CHARS = "".join(chr(c) for c in [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F,
                                     0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                     0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
# Python's str.splitlines() boundaries.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# Byte-level pre-tokeniser (GPT-2 pattern, Unicode classes).
BYTE_LEVEL_PATTERN = (r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                      r"|\s+(?!\S)|\s+")
# The same pre-tokeniser applied line by line (newline kept at the line end), as
# one pattern over the whole text: only the whitespace alternatives could cross
# a newline, so they stop at it (a run ending in "\n" is one piece).
BYTE_LEVEL_LINES_PATTERN = (r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                            r"|[^\S\n]*\n|[^\S\n]+(?!\S)|[^\S\n]+")
# Word / punctuation pre-tokeniser.
WORD_PATTERN = r"(?U)\w+|[^\w\s]+"
# Characters outside U+0000..U+017F may change under NFC; inside, text is NFC-stable.
MAYBE_NOT_NFC = r"[^\x{0}-\x{17F}]"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    An expression referenced inside an element lambda is otherwise evaluated
    again for every element (quadratic work on long arrays)."""
    return F.get(F.transform(F.array(value), body), 0)


def quote_regex(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in s)


def py_strip(col: Column) -> Column:
    """str.strip(): remove leading/trailing Unicode whitespace."""
    return F.btrim(col, F.lit(WS_CHARS))


def is_blank(col: Column) -> Column:
    """True when the string holds only whitespace (or is empty)."""
    return ~col.rlike(NON_WS_CLASS)


def split_lines(col: Column) -> Column:
    """str.splitlines() on an already stripped text (no trailing break)."""
    return F.split(col, LINE_BREAK, -1)


def split_keep_newline(col: Column) -> Column:
    """Lines with their trailing newline kept, as a trainer reading a file sees them."""
    return F.filter(F.split(col, r"(?<=\n)", -1), lambda s: F.length(s) > 0)


def extract_all(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def isolate_specials(col: Column, specials: list[str]) -> Column:
    """Split text around reserved tokens, keeping each reserved token as its own piece."""
    alt = "|".join(quote_regex(s) for s in specials)
    pieces = F.split(col, f"(?=(?:{alt}))|(?<=(?:{alt}))", -1)
    return F.filter(pieces, lambda s: F.length(s) > 0)


def md5_key(*cols) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(c) if isinstance(c, str) else c for c in cols]))


def hash_uniform(key: Column) -> Column:
    """Deterministic uniform in (0, 1) from the first 52 bits of md5(key)."""
    bits = F.conv(F.substr(F.md5(key), F.lit(1), F.lit(13)), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2 ** 52))


def hash_int(key: Column) -> Column:
    """Deterministic non-negative 60-bit integer from md5(key)."""
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


@F.pandas_udf(StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc_normalize(df: DataFrame, col: str) -> DataFrame:
    """Unicode NFC of ``col``.

    Spark has no built-in normaliser.  Text made only of U+0000..U+017F is
    already NFC, so only rows with other characters carry their text through the
    Arrow UDF; the others send a null and keep what they have.  One scan.
    """
    needs = F.col(col).rlike(MAYBE_NOT_NFC)
    return df.withColumn(col, F.coalesce(_nfc_udf(F.when(needs, F.col(col))), F.col(col)))


def byte_hex_symbols(col: Column) -> Column:
    """UTF-8 bytes of a string as an array of two-digit upper-case hex strings."""
    return extract_all(F.hex(F.encode(col, "UTF-8")), "..")
