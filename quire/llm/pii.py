"""Personal data by anchor expansion (free style: Arrow UDF, one pass, no shuffle).

An Aho-Corasick automaton finds the anchors: at-signs, plus-signs, digits,
address schemes and identifier cues.  From each anchor a deterministic local
parser expands to the left and right, validates, and fixes the span.  Text
between anchors is never looked at twice, so the cost follows the text.

Kinds, in the order in which spans are listed:

* ``email``, ``ip``, ``card``, ``phone``: the base kinds.  Spans are leftmost and
  non-overlapping per kind; a match that fails its validation is dropped and
  the scan goes on behind it.
* ``address``: a scheme address whose authority carries a user
  (``https://user:pw@host``), from the scheme to the end of the authority.
* ``account``: the value behind an identifier cue and a separator
  (``token = "..."``): 8 characters or more with a digit in it.

Defined cases: null text counts as empty; empty text has no spans; repeated
rows get the same spans each; an empty table stays empty.  Other columns,
whatever their names, pass through.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("address", "account")

SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"

# ---- fixed values (anchors) ----
CUES = ("token", "api_key", "api key", "apikey", "secret", "password", "passwd", "account",
        "acct", "iban", "passport", "user id", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN = re.compile(r"[0-9.]+")
#: Parts are whole digit groups: a match starts where a group starts, so a run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD_RUN = re.compile(r"[0-9\x20-]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>]+")
_VALUE = re.compile(r"[\"']?[\x20]*[:=#][\x20]*[\"']?([A-Za-z0-9_+/.-]{8,})")


def luhn(digits: str) -> bool:
    """Luhn's check: every second digit from the right doubled, digit sums added up."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for s in "@+":
        a.add_word(s, (s, 1))
    for d in "0123456789":
        a.add_word(d, ("0", 1))
    a.add_word("://", (":", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Spans of one text, by kind as listed, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_done = card_done = phone_end = address_end = account_end = 0
    for last, (what, size) in anchors.iter(text):
        at = last - size + 1
        if what == "0":
            if at >= ip_done:
                ip_done = _IP_RUN.match(text, at).end()
                for m in _IP.finditer(text, at, ip_done):
                    if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                        found["ip"].append(m.span())
            if at >= card_done:
                card_done = _CARD_RUN.match(text, at).end()
                for m in _CARD.finditer(text, at, card_done):
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif what == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found["email"].append((start, email_end))
        elif what == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif what == ":":
            start = at
            while start > address_end and text[start - 1] in _SCHEME:
                start -= 1
            m = _AUTHORITY.match(text, last + 1)
            if m and start < at and "@" in m[0][1:-1]:
                address_end = m.end()
                found["address"].append((start, address_end))
        elif at >= account_end and not (at and text[at - 1].isalnum()):
            m = _VALUE.match(text, last + 1)
            if m and any(c.isdigit() for c in m[1]):
                account_end = m.end(1)
                found["account"].append(m.span(1))
    return [(k, s, e) for k in KINDS for s, e in found[k]]


_state: dict[str, ahocorasick.Automaton] = {}


def _anchors() -> ahocorasick.Automaton:
    if "a" not in _state:
        _state["a"] = automaton()
    return _state["a"]


def find_spans(text: Column) -> Column:
    """Spans of a text column as ``SPAN_TYPE`` (never null)."""
    @F.arrow_udf(SPAN_TYPE)
    def run(col: pa.Array) -> pa.Array:
        a = _anchors()
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, a)] if t else []
                         for t in (v.as_py() for v in col)],
                        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
    return run(text)


def redact(text: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; null stays null.

    Overlapping spans are replaced as one, named after the first kind listed.
    """
    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        a = _anchors()
        return pa.array([t and _redacted(t, spans_of(t, a)) for t in (v.as_py() for v in col)], pa.string())
    return run(text)


def _redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    if not spans:
        return text
    joined: list[list] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if joined and s < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], e)
            joined[-1][0] = min(joined[-1][0], k, key=KINDS.index)
        else:
            joined.append([k, s, e])
    out, at = [], 0
    for k, s, e in joined:
        out += [text[at:s], f"<{k.upper()}>"]
        at = e
    return "".join(out) + text[at:]


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    d = docs.select(F.col(id_col).alias("doc_id"), find_spans(F.col(text_col)).alias("s"))
    base = F.filter("s", lambda x: x["kind"].isin(*BASE_KINDS))
    return d.select("doc_id",
                    *[_count(F.col("s"), k).alias(f"n_{k}") for k in BASE_KINDS],
                    F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("s")).alias("spans"))
