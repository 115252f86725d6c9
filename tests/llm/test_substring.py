import hashlib
import random
import re

from quire.llm import substring
from quire.llm.sketch import RepeatSketch


def brute(rows, k):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - k + 1):
                g = tuple(w[i:i + k])
                least[g] = min(d, least.get(g, d))
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - k + 1):
                if least[tuple(w[i:i + k])] < d:
                    gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def _removed(rows, k):
    """Texts without covered words and the white space behind them."""
    words = [(d, t, [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]) for d, t in rows]
    least = {}
    for d, t, w in words:
        for i in range(len(w) - k + 1):
            g = tuple(t[a:b] for a, b in w[i:i + k])
            least[g] = min(d, least.get(g, d))
    out = []
    for d, t, w in words:
        gone = {j for i in range(len(w) - k + 1) if least[tuple(t[a:b] for a, b in w[i:i + k])] < d for j in range(i, i + k)}
        ends = [a for a, _ in w[1:]] + [len(t)]
        out.append((d, t[:w[0][0]] + "".join(t[a:e] for i, ((a, _), e) in enumerate(zip(w, ends)) if i not in gone) if w else t))
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("xyzé")
    passages = [[word() for _ in range(rnd.randint(13, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passages)
            at = rnd.randint(0, len(w))
            w[at:at] = p[rnd.randint(0, 3):]
        rows.append((i // 2 * 2 if i % 10 == 0 else i, rnd.choice([" ", "\n", "  "]).join(w)))
    return rows + [(7, rows[7][1]), (5000, rows[3][1]), (None, rows[4][1]), (5001, None), (5002, "")]


def check(spark, rows, k, sketch=None):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, tkey int").repartition(5)
    got = sorted((tuple(r) for r in substring.removal_report(df, k, sketch).collect()), key=repr)
    assert got == brute(rows, k)


def test_equals_brute_force(spark):
    check(spark, corpus(1), 13)
    check(spark, corpus(2), 4)


def test_tiny_sketch_loses_nothing(spark):
    check(spark, corpus(3), 13, RepeatSketch(bits=8, depth=2, shards=4))


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60000))
    check(spark, [(1, "x " + long), (2, long), (3, "a b")], 13)
    assert substring.removal_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_removed_text_keeps_its_layout(spark):
    p = " ".join(f"p{i}" for i in range(15))
    df = spark.createDataFrame([(1, f"a\n{p}\nb", "s"), (2, f"  c  d\n{p}  e\n f", "s"), (3, None, "s")],
                               "doc_id long, text string, starts string")
    got = {r["doc_id"]: (r["text"], r["starts"]) for r in substring.remove_repeats(df).collect()}
    assert got == {1: (f"a\n{p}\nb", "s"), 2: ("  c  d\ne\n f", "s"), 3: (None, "s")}


def test_long_alternating_words_are_told_apart(spark):
    one = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([one] * 13)), (2, " ".join([other] * 13)), (3, f"c {' '.join([one] * 13)} d")]
    got = substring.removal_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows, 13)
