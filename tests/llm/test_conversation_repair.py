"""Repair of conversations against all audits of short ones, and in blocks against whole."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import conversation_repair as C


def every_repair(turns, costs):
    """The cheapest audit, ASCII-least among equals, by trying all of them with up to two inserts before each turn and at the end. turns: role, text, fault."""
    best = None
    for runs in product(range(3), repeat=len(turns) + 1):
        for edits in product("DKR", repeat=len(turns)):
            cost, lines = sum(runs) * costs.insert, [[]]
            # A rerole, or an insert, can make either role.
            for k, e, (role, text, fault) in zip(runs, edits, turns):
                for _ in range(k):
                    lines = [x + [(r, "")] for x in lines for r in ("user", "assistant")]
                cost += {"D": costs.delete, "K": 0, "R": costs.rerole}[e] + (costs.truncated if fault == C.TRUNCATED and e != "D" else 0)
                if e != "D" and fault in (C.BLANK, C.DUPLICATE):
                    lines = []
                elif e == "K":
                    lines = [x + [(role, text)] for x in lines]
                elif e == "R":
                    lines = [x + [(r, text)] for x in lines for r in ("user", "assistant")]
                lines = [x for x in lines if re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in x)) and all(r[:1] for r, _ in x)]
            for _ in range(runs[-1]):
                lines = [x + [(r, "")] for x in lines for r in ("user", "assistant")]
            audit = "".join("I" * k + e for k, e in zip(runs, edits)) + "I" * runs[-1]
            for x in lines:
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in x)) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, "\n".join(f"{r}:{t}" for r, t in x)
    return best


@pytest.mark.parametrize("costs", [C.Costs(), C.Costs(insert=1), C.Costs(rerole=3, delete=3, insert=1, truncated=1), C.Costs(rerole=2, delete=4, insert=2, truncated=0), C.Costs(rerole=1, delete=1, insert=1, truncated=2)])
def test_cheapest_and_least_of_all_audits(costs):
    rng = random.Random(5)
    program = C.Program(costs)
    for _ in range(60):
        turns = [(i, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rng.choice(["Yes.", "No!", f"t{i}?", "cut off", " \t", "Same."])) for i in range(rng.randint(0, 4))]
        got = C.repaired([(n, r, t.encode()) for n, r, t in turns], program)
        seen, faulty = set(), []
        for _, r, t in turns:
            faulty.append((r, t, C.fault_of(t.encode(), (r, t) in seen)))
            seen.add((r, t))
        cost, audit, text = every_repair(faulty, costs)
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_inserts_are_used_where_they_are_cheap():
    got = C.repaired([(0, "system", b"S."), (1, "assistant", b"A."), (2, "user", b"U.")], C.Program(C.Costs(rerole=9, delete=9, insert=1)))
    assert (got["audit"], got["cost"]) == ("KIKKI", 2)
    assert got["repaired_sha256"] == hashlib.sha256(b"system:S.\nuser:\nassistant:A.\nuser:U.\nassistant:").hexdigest()


def plain(rows):
    """op12 by loops, with the program of one conversation at a time; rows: conv_id, turn, role, text."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            turns += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, n = set(), [0, 0, 0]
        for _, r, t in turns:
            bare = t.strip(" \t\n\x0b\x0c\r")
            if not bare:
                n[0] += 1
            elif (r, t) in seen:
                n[1] += 1
            elif bare[-1] not in ".!?":
                n[2] += 1
            seen.add((r, t))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        got = C.repaired([(t, r, x.encode()) for t, r, x in turns], C.Program())
        out[conv] = (gaps, *n, illegal, got["cost"], got["audit"], got["repaired_sha256"])
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, times int, block string, pos string")


def some(seed, n, convs):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "assistant", "user", "system", None, "tool", ""], ["Ja. ", "nein", None, "", " \n", "Gut!\x0b", "a\x1c", "wörd?", "x" * 3_000 + "."]
    return [(rng.choice(convs), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {i}.") for i in range(n)]


EDGES = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (2, None, None, None), (None, 3, "user", "A."), (None, None, "assistant", "B."), (3, 5, "user", ""), (3, -2, "assistant", "C"), *[(4, t, "user", "D.") for t in range(40)]]


def test_query_equals_loops(spark):
    rows = EDGES + some(3, 400, [5, 6, 7, 8, 9, 10, 11])
    got = C.repair(C.damaged(conversations(spark, rows).repartition(5))).collect()
    assert got[0].__fields__ == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got} == plain(rows) and len(got) == len(plain(rows))
    gone = {c for c, v in plain(rows).items() if v[-1] == hashlib.sha256(b"").hexdigest()}
    assert gone  # a conversation of which nothing is left is reported too


def test_no_conversations(spark):
    none = conversations(spark, EDGES).filter("conv_id > 100")
    assert C.repair(C.damaged(none)).count() == 0


@pytest.mark.parametrize("costs, block", [(C.Costs(), 7), (C.Costs(), 1), (C.Costs(rerole=3, delete=4, insert=1, truncated=1), 5)])
def test_blocks_of_long_conversations_give_the_same(spark, costs, block):
    """Conversations of over 20 turns are cut into blocks; one holds a third of all rows, one is whole."""
    rows = some(9, 300, [None, 6, 6, 6, 7, 8, *range(20, 40)]) + [(50, 0, "user", "Ja."), *[(51, None, "assistant", "Same.")] * 90, *[(52, t, "user", "") for t in range(30)]]
    turns = C.damaged(conversations(spark, rows).repartition(6))
    whole, cut = (sorted(map(tuple, C.repair(turns, costs, most, block=block).collect()), key=str) for most in (10_000, 20))
    assert whole == cut
    assert sum(1 for r in rows if r[0] == 6) > 20


def test_the_driver_s_conversations(spark, sf):
    d = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in d.select("conv_id", "turn", "role", "text").collect()]
    got = C.op12(spark, sf)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == plain(rows)
    assert got.agg(F.max("cost")).first()[0] > 0
