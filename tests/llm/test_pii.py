import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                  "card": 16 <= len(digits) <= 19 and pii.luhn(digits) if kind == "card" else True,
                  "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@+-1290 5(%é\n_", max_size=60))
def test_base_spans_equal_the_patterns(text):
    got = [s for s in pii.spans_of(text, pii.automaton()) if s[0] in pii.BASE_KINDS]
    assert got == brute(text)


def test_cards_phones_and_ips():
    t = "4539 1488 0343 6467, +49 (30) 1234-5678, 10.0.0.256.1.2.3.4 and 1.2.3.4.5 999.1.1.1"
    got = [s for s in pii.spans_of(t, pii.automaton()) if s[0] in pii.BASE_KINDS]
    assert got == brute(t) and {k for k, *_ in got} == {"ip", "card", "phone"}


def test_very_long_runs_of_zeros():
    t = "0" * 5000 + ".1.1.1 and " + "0" * 5000 + "256.1.1.1"
    assert pii.spans_of(t, pii.automaton()) == [("ip", 0, 5006)]


def test_time_follows_the_text():
    a = pii.automaton()
    n = 1_000_000
    long = ["7" * n, "7" * n + ".1.1.1", "1.1.1 " * (n // 6), "1.2." * (n // 4), "1 1-" * (n // 4), "+1" * (n // 2), "a@" * (n // 2)]
    start = time.process_time()
    found = [[k for k, *_ in pii.spans_of(t, a)] for t in long]
    assert time.process_time() - start < 2 * len(long)
    assert found[:3] == [[], [], []] and found[3] == ["ip"] * (n // 8) and found[6] == []


def test_added_kinds_and_redaction():
    a = pii.automaton()
    t = 'see https://bob:pw1@ex.org/x and token = "24be64439e3e49cf", password: short, plain token words'
    kinds = [(k, t[s:e]) for k, s, e in pii.spans_of(t, a)]
    assert ("address", "https://bob:pw1@ex.org") in kinds and ("account", "24be64439e3e49cf") in kinds
    assert pii._redacted(t, pii.spans_of(t, a)) == ('see <EMAIL>/x and token = "<ACCOUNT>", password: short, '
                                                    "plain token words")
    assert pii._redacted("clean text 12", []) == "clean text 12"


def test_report_cases(spark):
    rows = [(1, "mail a@b.co", "x"), (None, None, "y"), (2, "", "z"), (2, "", "z"), (3, "é" * 200000 + " a@b.co", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r["doc_id"], r["n_email"], r["spans"]) for r in pii.pii_report(df).collect()}
    assert got == {(1, 1, "email:5:11"), (None, 0, ""), (2, 0, ""), (3, 1, "email:200001:200007")}
    r = pii.pii_report(df).where("doc_id = 1").first()
    assert r["base_sha256"] == hashlib.sha256(b"email:5:11").hexdigest()
    assert pii.pii_report(df.where("false")).count() == 0
    assert {r[0] for r in df.select(pii.redact(df.text)).where("doc_id = 1 or doc_id is null").collect()} == {"mail <EMAIL>", None}
