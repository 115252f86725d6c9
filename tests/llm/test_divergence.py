import re
from collections import Counter, defaultdict

import pytest

from quire.llm import divergence as D

SF = "/root/testdata/sf0.001"


def plain(rows, least=3, top=200):
    """Every value from dense dictionaries of Python integers."""
    count, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", l or "", s or "") for t, l, s in rows):
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        count[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, source in count:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = [s for l, s in count if l == lang]
        shares = {}
        for s in sources:
            n = sum(count[lang, s][t] for t in kept)
            shares[s] = {t: 1 + 10**9 * (count[lang, s][t] + 1) // (n + len(kept)) for t in kept}
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        p = shares[source]
        pair = [(s, sum((p[t] - shares[s][t]) ** 2 // shares[s][t] for t in kept)) for s in sources if s != source]
        term = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pair, None), ("term", term, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])]
    return sorted(out)


def audited(df, **kw):
    return sorted(tuple(r) for r in D.audit(df, **kw).collect())


def test_equals_dense_integers_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = audited(docs)
    assert got == plain([(r.text, r.lang, r.source) for r in docs.collect()]) and len(got) > 5000


def test_many_sources_span_several_blocks(spark, monkeypatch):
    rows = [(f"common t{i % 7}x word{'a' * (i % 11)} É{'z' * (i % 5)}", "xx", f"s{i % 150}") for i in range(600)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    want = plain(rows)
    assert audited(df) == want and len(want) > 150 * 149
    monkeypatch.setattr(D, "ENTRIES", 10)
    assert audited(df.repartition(2)) == want


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "a"), ("only once here", "de", "q"), ("A_b1c é" * 3, "en", "a"), ("b c É", "en", None),
            ("b c\x00é", "en", ""), ("b c é", "en", "b"), ("b c é", "en", "b"), ("é " * 400_000 + "b", "en", "long"),
            ("x" * 3_000_000, "en", "long"), ("!!!", "xx", "one"), ("???", "xx", "two")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "text string, lang string, source string, count int, term string")
    got = audited(df)
    assert got == plain(rows)
    assert ("xx", "one", "pair", "two", 0, 1) in got
    assert audited(df.where("false")) == []


def test_ranks_are_cut_by_value_then_term(spark):
    rows = [(" ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), "en", s) for s in "aabb"] + [("zz " * 50, "en", "b")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = audited(df)
    assert got == plain(rows) and max(r[5] for r in got if r[2] == "term") == 200
    assert len(audited(df, top=5)) < len(got)


@pytest.mark.parametrize("size", [1, 1 << 10, 1 << 20])
def test_pieces_of_a_text_give_the_counts_of_the_whole(size, monkeypatch):
    monkeypatch.setattr(D, "PIECE", size)
    text = ("Ab ç,d " * 3000).encode()
    assert D.document_terms(text) == Counter({b"ab": 3000, "ç".encode(): 3000, b"d": 3000})
