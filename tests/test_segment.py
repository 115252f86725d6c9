from hypothesis import given, settings, strategies as st

from quire.operators import segment as S

S_, E_ = "<|S|>", "<|E|>"

# Hand-derived cases: input -> marked text (S/E stand for the markers).
CASES = [
    ("", "S\nE\n"),
    ("T\n\na\nb\nc\n\nd", "S\nT\n\na\nb\nc\nE\nS\nd\nE\n"),
    ("a\nb\n\nc", "S\na\nb\n\nc\nE\n"),
    ("a\nb\nc\n\n\nd\ne\nf", "S\na\nb\nc\nE\nS\n\nd\ne\nf\nE\n"),
    ("  \n a \n", "S\na\nE\n"),
    ("a\nb\nc\n \t\nd", "S\na\nb\nc\nE\nS\nd\nE\n"),
    ("a\n \nb", "S\na\n \nb\nE\n"),
    ("a\nb\nc", "S\na\nb\nc\nE\n"),
    ("a\x85b\nc\n\nd", "S\na\nb\nc\nE\nS\nd\nE\n"),
    ("x\r\ny\rz\n \nq", "S\nx\ny\nz\nE\nS\n\nq\nE\n"),
]


def _expand(s):
    return s.replace("S\n", S_ + "\n").replace("E\n", E_ + "\n")


def model(text):
    """Plain-Python restatement of the rule, for property checks."""
    lines = text.strip().splitlines()
    if not lines:
        return f"{S_}\n{E_}\n"
    blank = [not l.strip() for l in lines]
    out = []
    for i, l in enumerate(lines):
        if blank[i] and i >= 3 and not any(blank[i - 3:i]):
            out.append(f"{E_}\n{S_}")
        else:
            out.append(l)
    return f"{S_}\n" + "\n".join(out) + f"\n{E_}\n"


def test_hand_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id long, text string")
    got = dict(S.mark_segments(df).select("id", "segmented").collect())
    for i, (_, want) in enumerate(CASES):
        assert got[i] == _expand(want), (CASES[i][0], got[i])


def test_loader_cases(spark):
    rows = [(0, f"{S_}\na\n{E_}\n{S_}\n{E_}\n"), (1, f"pre {S_}\nx"), (2, f"{S_}\n \n{S_}\nx")]
    df = spark.createDataFrame(rows, "id long, segmented string")
    out = S.load_segments(df, "id").orderBy("id", "seg_id").collect()
    got = {}
    for r in out:
        got.setdefault(r.id, []).append(r.body)
    assert got[0] == [f"{S_}\na\n{E_}", f"{S_}\n{E_}"]
    assert got[1] == [f"{S_}\npre", f"{S_}\nx"]
    assert got[2] == [f"{S_}\nx"]


line = st.sampled_from(["a", "bb", "", " ", "\t", "c d", "　"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(line, max_size=12), min_size=1, max_size=8))
def test_rule_matches_model(spark, docs):
    texts = ["\n".join(d) for d in docs]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = dict(S.mark_segments(df).select("id", "segmented").collect())
    for i, t in enumerate(texts):
        assert got[i] == model(t)
