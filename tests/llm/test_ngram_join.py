import random
import re

import numpy as np

from quire.llm import components as C
from quire.llm import ngram_join as J


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted([(d, len(s), None if d is None else low[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("ABcdefghij") + rnd.choice("klmnopé")
    passage = [word() for _ in range(30)]
    rows, base = [], []
    for i in range(160):
        if base and rnd.random() < 0.6:
            w = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.4:
                base.append(w)          # chains of edits
        else:
            w = [word() for _ in range(rnd.randint(1, 90))]
            if rnd.random() < 0.3:
                w += passage
            base.append(w)
        rows.append((rnd.randrange(10 ** 6), " ".join(w).swapcase() if rnd.random() < 0.2 else "\n".join(w)))
    return rows + [(10 ** 7, None), (10 ** 7 + 1, ""), (None, rows[0][1]), (10 ** 7 + 2, "one two"), (10 ** 7 + 3, "One\ttwo"),
                   (10 ** 7 + 4, rows[5][1])]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_TOKENS", 400)      # several pieces per block
    monkeypatch.setattr(J, "BLOCK_ROWS", 3)
    rows = corpus(1)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, rep int").repartition(5)
    got = sorted((tuple(r) for r in J.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows) and len({c for *_, c in got}) < len(got)


def test_empty_and_long(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"w{i * i % 70001}" for i in range(50000))
    df = spark.createDataFrame([(5, long), (3, long + " x"), (9, "a b c d e f")], "doc_id long, text string")
    assert {tuple(r)[::2] for r in J.near_duplicates(df).collect()} == {(5, 3), (3, 3), (9, 9)}


def test_search_counts_overlaps():
    rnd = np.random.default_rng(0)
    sets = [np.sort(rnd.choice(60, rnd.integers(5, 50), replace=False)) for _ in range(80)]
    index = J.Index(list(range(80)), sets)
    for q in sets[:40] + [np.sort(rnd.choice(60, 45, replace=False)) for _ in range(40)]:
        want = [(i, o) for i, s in enumerate(sets) if 100 * (o := len(set(s) & set(q))) >= 80 * len(set(s) | set(q))]
        assert index.search(q) == want


def test_bitmaps_never_differ_more_than_the_sets():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 3000, rnd.integers(0, 900)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(40)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    maps = [np.frombuffer(b, np.uint8) for b in J.parity_bitmaps(np.concatenate(sets), at)]
    for a, x in zip(sets, maps):
        for b, y in zip(sets, maps):
            w = min(len(x), len(y))
            assert np.bitwise_count(J.fold(x, w) ^ J.fold(y, w)).sum() <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(4)
    names = rnd.sample(range(10 ** 6), 300)
    edges = [(names[i], names[i + 1]) for i in range(120)] + [(names[150], names[i]) for i in range(151, 250)] + [(names[299], names[299])]
    got = {r["id"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for part in (names[:121], names[150:250]):
        assert {got.get(x, x) for x in part} == {min(part)}
    assert not got.keys() & set(names[121:150] + names[250:])


def test_components_give_one_row_per_node(spark):
    rnd = random.Random(5)
    chain = [(i, i + 1) for i in range(1, 10)]                              # increasing: parents stay end points
    tree = [(1000 + rnd.randrange(i), 1000 + i) for i in range(1, 400)]     # copies of copies
    rows = C.components(spark.createDataFrame(chain + tree, "a long, b long")).collect()
    assert sorted(map(tuple, rows)) == [(i, 1) for i in range(2, 11)] + [(i, 1000) for i in range(1001, 1400)]


def test_long_alternating_words_are_told_apart(spark):
    one = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, other), (3, f"x {one} x y z"), (4, f"x {other} x y z"), (5, other)]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows)
