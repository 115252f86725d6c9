import hashlib
import itertools
import random
import re
import zlib

import pytest

from quire.llm import turns as T

WS = " \t\n\x0b\x0c\r"


def audit_and_cost(rows):
    """Every edit sequence with up to two inserts anywhere, the least (cost, audit); rows: (initial, fault)."""
    best = {("", ""): 0}
    fits = re.compile(r"s?(ua)*u?")

    def put(table, key, cost):
        if fits.fullmatch(key[0]) and cost < table.get(key, 10**9):
            table[key] = cost
    for initial, fault in [*rows, (None, None)]:
        grown = {}
        for (roles, audit), cost in best.items():
            for extra in ("", "u", "a", "ua", "au"):
                put(grown, (roles + extra, audit + "I" * len(extra)), cost + 3 * len(extra))
        if initial is None:
            best = grown
            break
        best = {}
        for (roles, audit), cost in grown.items():
            put(best, (roles, audit + "D"), cost + 4)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                put(best, (roles + initial, audit + "K"), cost + more)
                for x in "ua":
                    put(best, (roles + x, audit + "R"), cost + 3 + more)
    cost, audit, roles = min((c, a, r) for (r, a), c in best.items() if re.fullmatch("(s?(ua)+)?", r))
    return cost, audit, roles


def cheapest(rows):
    """The same for longer conversations: least (cost, audit, roles) by what the roles end with."""
    def grow(table, put):
        out = {}
        for cost, audit, roles in table.values():
            for more, letter, x in put:
                r = roles + x
                if re.fullmatch(r"s?(ua)*u?", r):
                    end = r[-1:]
                    out[end] = min(out.get(end, (10**9,)), (cost + more, audit + letter, r))
        return out
    best = {"": (0, "", "")}
    inserts = [(0, "", ""), (3, "I", "u"), (3, "I", "a"), (6, "II", "ua"), (6, "II", "au")]
    for initial, fault in rows:
        more = 3 if fault == "truncated" else 0
        edits = [] if fault in ("blank", "duplicate") else [(more, "K", initial or "-"), (3 + more, "R", "u"), (3 + more, "R", "a")]
        both = [(a + c, b + d, x + y) for a, b, x in inserts for c, d, y in [(4, "D", ""), *edits]]
        best = grow(best, both)
    return min(v for v in grow(best, inserts).values() if re.fullmatch("(s?(ua)+)?", v[2]))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain(rows):
    """The report by brute force; damaged rows are (conv, turn, role, text)."""
    convs = {r[0] for r in rows}
    rows, out = damage(rows), {}
    for conv in convs:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            t = text.strip(WS)
            faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, roles = cheapest([(r[2][:1], f) for r, f in zip(mine, faults)])
        full, lines, at = {"s": "system", "u": "user", "a": "assistant"}, [], iter(mine)
        roles = iter(roles)
        for letter in audit:
            row = None if letter == "I" else next(at)
            if letter != "D":
                x = next(roles)
                lines.append(f"{row[2] if letter == 'K' else full[x]}:{row[3] if row else ''}")
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def reported(df):
    d = T.damaged(df)
    rows = [tuple(r) for r in T.repair_report(d, d["gone"]).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("n", range(4))
def test_every_short_conversation(n):
    for rows in itertools.product([(i, f) for i in "suax" for f in ("", "blank", "truncated")], repeat=n):
        if n == 3 and zlib.crc32(repr(rows).encode()) % 8:      # keeps the run short
            continue
        got = []
        r = T.Repair(lambda *e: got.append(e))
        for i, f in rows:
            r.push({"s": "system", "u": "user", "a": "assistant", "x": "x"}[i], "t", f)
        cost = r.finish()
        assert (cost, "".join(e[0] for e in got), "".join(e[1][0] for e in got if e[1])) == audit_and_cost(rows) == cheapest(rows), rows


def test_settling_early_changes_nothing(monkeypatch):
    rnd = random.Random(4)
    for _ in range(300):
        rows = [(rnd.choice("suaaux"), rnd.choice(["", "", "", "blank", "truncated"])) for _ in range(rnd.randrange(12, 40))]
        results = []
        for room in (2, 5, 64):
            monkeypatch.setattr(T, "ROOM", room)
            got = []
            r = T.Repair(lambda *e: got.append(e))
            for i, f in rows:
                r.push({"s": "system", "u": "user", "a": "assistant", "x": "x"}[i], "t", f)
            results.append((r.finish(), got))
        assert results[0] == results[1] == results[2]


def test_equals_brute_force_on_the_table(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = reported(conv.repartition(7))
    assert got == plain([tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()])
    assert {len(v[6]) > 0 for v in got.values()} >= {True} and sum(v[5] for v in got.values()) > 0


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "a."), (1, None, "user", ""), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"),
            (1, 2, "", "x!"), (2, 7, "user", "\t\n"), (3, 0, "SYSTEM", "q?"), (3, 9, "system", "q? "), (3, 9, "user", "é" * 2_000_000 + "."),
            (4, 1, "üser", "a."), (4, -5, "user", "a."), (4, 1 << 40, "assistant", "a\nb.")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, copy int, gone boolean")
    assert reported(df) == plain(rows)
    assert reported(df.where("false")) == {}
    names = spark.createDataFrame([("x", 0, "user", "a."), (None, 0, "user", "b.")], "conv_id string, turn int, role string, text string")
    assert set(reported(names)) == {"x", None}


def test_dropped_rows_leave_their_conversation(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, gone, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert reported(df) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_conversation_is_streamed_in_order(spark):
    rnd = random.Random(2)
    rows = [(1, t, rnd.choice(["user", "assistant"]), f"t {t}.") for t in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    report = T.repair_report(df).collect()
    text = [r for r in T.repaired(df).collect()]
    assert [r["position"] for r in text] == list(range(len(text)))
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in text))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in text).encode()).hexdigest() == report[0]["repaired_sha256"]
    assert len(report) == 1 and report[0]["audit"].replace("D", "") == "".join(r["edit"] for r in text)
    got = []
    many = T.Repair(lambda *e: got.append(e))
    for k in range(20_000):
        many.push("user" if k % 2 == 0 else "assistant", "t", "")
    assert len(many.rows) < 100 and many.finish() == 0 and len(got) == 20_000
