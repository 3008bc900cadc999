"""Conversation repair against all edit strings of small conversations and a plain dynamic program."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skilltide.llm import conversation_repair as cr
from skilltide.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string"
LEGAL = re.compile("(s?(ua)+)?")
CHAR = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if v is None else v for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        what = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        out += [(conv, turn, role, text)] * (2 if what == 3 else 1)
    return out


def digest(row):
    return hashlib.sha256(f"{len(row[2])}:{row[2]}{row[3]}".encode()).digest()


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        chars = CHAR.findall(text)
        found.append("blank" if not chars else "duplicate" if (role, text) in seen
                     else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def best(rows, marks):
    """Cheapest (cost, audit) by recursion over rows and the initials so far."""
    sys.setrecursionlimit(20_000)
    memo = {}
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def go(i, state, inserted):
        if (i, state, inserted) in memo:
            return memo[i, state, inserted]
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for r in "ua":
                if (state, r) in step:
                    c, a = go(i, step[state, r], inserted + 1)
                    ways.append((c + 2, "I" + a))
        if i < len(rows):
            c, a = go(i + 1, state, 0)
            ways.append((c + 3, "D" + a))
            if marks[i] not in ("blank", "duplicate"):
                more = marks[i] == "truncated"
                if (state, rows[i][2][:1]) in step:
                    c, a = go(i + 1, step[state, rows[i][2][:1]], 0)
                    ways.append((c + more, "K" + a))
                for r in "ua":
                    if (state, r) in step:
                        c, a = go(i + 1, step[state, r], 0)
                        ways.append((c + 2 + more, "R" + a))
        memo[i, state, inserted] = min(ways, default=(10 ** 9, "~"))
        return memo[i, state, inserted]

    return go(0, "", 0)


def replay(rows, audit):
    out, left, state = [], iter(rows), ""
    for edit in audit:
        due = "assistant" if state == "u" else "user"
        if edit == "I":
            out.append((due, ""))
        else:
            _, _, role, text = next(left)
            if edit == "D":
                continue
            out.append((due if edit == "R" else role, text))
        state = out[-1][0][:1]
    assert next(left, None) is None and LEGAL.fullmatch("".join(r[:1] for r, _ in out))
    return out


def brute(rows, damage=True):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]]
    for r in damaged(rows) if damage else [(*r[:2], *(" " if v is None else v for v in r[2:])) for r in rows]:
        groups[r[0]].append(r)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r)))
        marks = faults(own)
        turns = {r[1] for r in own} - {None}
        initials = [r[2][:1] for r in own]
        cost, audit = best(own, marks)
        text = "\n".join(f"{r}:{t}" for r, t in replay(own, audit))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(
            marks.count(m) for m in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256(text.encode()).hexdigest())
    return out


def table(seed, n=150):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "usher"]
    texts = ["Yes.", "No!", "cut", " \n", "", None, "Ends. \t", "Ç?", "日本", "x" * 5000 + "."]
    rows = []
    for conv in [*range(n), None]:
        at = rng.randrange(3)
        for _ in range(rng.randrange(9)):
            rows.append((conv, None if rng.random() < 0.05 else at,
                         rng.choices(roles, [8, 8, 2, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < .6
                         else f"Text {rng.randrange(10 ** 6)}."))
            at += rng.randrange(4)
    return rows


def got(frame):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = frame.collect()
    found = {r["conv_id"]: tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = table(seed)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(6)
    assert got(queries.repaired_damage(df)) == brute(rows)


def test_long_shared_and_hot(spark):
    """A conversation with a third of all rows, and many with one signature."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t // 3}.") for t in range(600)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Word {t}.") for c in range(2, 300) for t in range(4)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(6)
    assert got(queries.repaired_damage(df)) == brute(rows)


def test_rows_of_the_operator(spark):
    rows = table(5, 40)
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    fixed = cr.repair(df)
    want = brute(rows, damage=False)
    by = defaultdict(list)
    for r in fixed.rows().collect():
        by[r["conv_id"]].append(r)
    for r in fixed.summary.collect():
        own = sorted(by[r["conv_id"]], key=lambda x: x["step"])
        assert "".join(x["edit"] for x in own) == r["audit"] == want[r["conv_id"]][6]
        text = "\n".join(f"{x['role']}:{x['text']}" for x in own if x["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == want[r["conv_id"]][7]


def test_empty_and_all_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert queries.repaired_damage(empty).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", "", "")], SCHEMA)
    assert got(queries.repaired_damage(df)) == {gone: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())}


def test_nodes_are_few_and_prefixes_common(spark):
    rng, solver = random.Random(6), cr.Solver()
    strings = sorted({"".join(rng.choices("suaoSUAOx", k=rng.randrange(12))).encode() for _ in range(5000)})
    for s in strings:
        solver.solve(s)
    assert len(solver.automaton.costs) < 200
    for _ in range(200):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(9))).encode() for _ in range(2))
        n = cr.common_prefix(a, b)
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversation_repair(spark, sf_dir)) == brute(rows)
