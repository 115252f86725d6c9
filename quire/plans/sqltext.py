"""Helpers shared by the DuckDB oracle strings (pure text, no execution)."""

from ..functions import text as T

# DuckDB string expression holding Python's whitespace set, built from code points.
WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in T.WS_CHARS) + ")"
NL = "chr(10)"
# Unicode White_Space (what Java's (?U)\s and the library's \s mean), as an RE2 class body.
UNI_WS = r"\t\n\x0B\x0C\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_RE2 = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_" + UNI_WS + "]+"
LINE_BREAK = T.LINE_BREAK
NON_WS = T.NON_WS_CLASS


def lit(s: str) -> str:
    """SQL string literal (single quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"
