"""Repair of conversations against all ways of editing them."""

import hashlib
import random
import re
import zlib

import pytest

from sparkloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, g string, `a.b` int, own long, block string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def damage(rows):
    """(turn, role, text) of a conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        chars = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_ways(rows, told, budget):
    """Every (audit, repaired rows) of a cost of at most ``budget`` that meets the grammar, by plain search."""
    found = []

    def go(at, cost, audit, made):
        if cost > budget or not re.fullmatch(r"(s?(ua)*u?)?", "".join(r[:1] or "-" for r, _ in made)):
            return
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
            found.append((cost, audit, made))
        for role in ("user", "assistant"):
            go(at, cost + 3, audit + "I", [*made, (role, "")])
        if at < len(rows):
            _, role, text = rows[at]
            go(at + 1, cost + 4, audit + "D", made)
            if told[at] not in ("blank", "duplicate"):
                more = 3 if told[at] == "truncated" else 0
                go(at + 1, cost + more, audit + "K", [*made, (role, text)])
                for new in ("user", "assistant"):
                    go(at + 1, cost + more + 3, audit + "R", [*made, (new, text)])

    go(0, 0, "", [])
    return found


def plain(conv_id, rows):
    rows = damage(rows)
    told = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    budget, ways = 0, []
    while not ways:  # deletes alone are a way
        ways = all_ways(rows, told, budget)
        budget += 1
    cost, audit, made = min(ways, key=lambda w: (w[0], w[1]))
    assert len({repr(m) for c, a, m in ways if (c, a) == (cost, audit)}) == 1
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))  # noqa: B905
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv_id, gaps, told.count("blank"), told.count("duplicate"), told.count("truncated"), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in made)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    made = []
    for conv in [*range(120), None]:
        for _ in range(r.randint(1, 5)):
            made.append((conv, r.choice([None, 0, 1, 2, 3, 5, 9]), r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), r.choice(["Yes.", "No", "", None, " \n", "Why?  ", "é", "x" * 3000 + "!"])))
    made += [(200, 0, "user", "Hi."), (200, 0, "user", "Hi."), (200, 1, "assistant", "Hello."), (201, None, None, None), (202, 2, "user", "\x1c"), (202, 3, "user", "\u00a0")]
    return made


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_against_all_ways(spark, rows, block):
    """Nulls, empty and long texts, ties, repeats, clashing names; blocks of a turn, of two, and whole conversations."""
    df = spark.createDataFrame([(*r, "g", 1, 2, "b") for r in rows], SCHEMA).repartition(3)
    got = sorted(map(repr, (tuple(x) for x in repair.damaged_and_repaired(df, block).collect())))
    assert got == sorted(repr(plain(c, own)) for c, own in by_conversation(rows).items())
    assert repair.damaged_and_repaired(df.limit(0)).count() == 0


def test_general_interface(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "user", "Again?"), ("a", 4, "assistant", "Well"), ("a", 4, "assistant", "Well"), ("b", 1, "bot", "x."), (None, None, "system", "S.")]
    report, fixed = repair.repair(spark.createDataFrame(rows, "chat string, no int, who string, said string"), id_col="chat", turn_col="no", role_col="who", text_col="said")
    told = {r["conv_id"]: r.asDict() for r in report.collect()}
    assert told["a"] == {"conv_id": "a", "gaps": 1, "blank": 0, "duplicate": 1, "truncated": 1, "illegal": 2, "cost": 10, "audit": "KIKKD"}
    assert told["b"]["audit"] == "D" and told["b"]["cost"] == 4 and told[None]["audit"] == "D"
    made = {}
    for r in fixed.orderBy("block", "place").collect():
        made.setdefault(r["conv_id"], []).append(r["role"][:1])
    assert set(made) == {"a"} and re.fullmatch("(ua)+", "".join(made["a"]))


def test_a_long_conversation_is_one_answer(spark):
    """Blocks of a long conversation give what one block gives."""
    r = random.Random(9)
    rows = [(1, k, r.choice(["user", "assistant", "system"]), r.choice(["A.", "b", f"{k}!", "", "What?"])) for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, many = (repair.damaged_and_repaired(df, b).collect() for b in (4096, 64))
    assert one == many and one[0]["cost"] > 100


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, repair.op13_repair(spark, sf).collect()))
    assert got == sorted(plain(c, own) for c, own in by_conversation(rows).items())
