"""Operator 11 against a search over all edits, on random and awkward conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from quillspark.llm import repair

TURNS = "conv_id long, turn long, role string, text string, pos string, `odd name` string"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """(cost, audit, repaired) of (role, text) rows: cheapest first, then least audit, by a search over single edits."""
    faults, seen = [], set()
    for role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if (at, roles[:1] == "s", roles[-1:]) in done:
            continue
        done.add((at, roles[:1] == "s", roles[-1:]))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out, faults

        def go(more, letter, to, turn, cost=cost, audit=audit, roles=roles, out=out):
            r = roles + (turn[0][:1] if turn else "")
            if not turn or re.fullmatch("s?(ua)*u?", r):
                heapq.heappush(heap, (cost + more, audit + letter, to, r, out + ((f"{turn[0]}:{turn[1]}",) if turn else ())))

        for role in ("user", "assistant"):
            go(2, "I", at, (role, ""))
        if at < len(rows):
            role, text = rows[at]
            go(3, "D", at + 1, None)
            if faults[at] in (None, "truncated"):
                more = int(faults[at] == "truncated")
                if role[:1] in "sua" and role:
                    go(more, "K", at + 1, (role, text))
                for other in ("user", "assistant"):
                    go(2 + more, "R", at + 1, (other, text))


def talk(rng, n):
    said = ["Yes.", "No!", "Well", "", " \n", "Why?", "So. ", "x ", " ", "long " * 50 + "."]
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "agent"]), rng.choice(said) if rng.random() < 0.4 else f"t{rng.random()}.") for _ in range(n)]


def code_of(rows):
    out = ""
    for (role, _), fault in zip(rows, brute(rows)[3], strict=True):
        c = role[:1] if role[:1] and role[:1] in "sua" else "-"
        out += "D" if fault in ("blank", "duplicate") else c.translate(str.maketrans(repair.SOUND, repair.SHORT)) if fault else c
    return out


def test_layers_and_blocks():
    rng = random.Random(3)
    for k in range(400):
        rows = talk(rng, rng.randint(0, 12))
        cost, audit, _, _ = brute(rows)
        code = code_of(rows)
        assert repair.solve(code) == (cost, audit)
        for size in (1, 2, 3, 5):
            blocks = [repair.ways(code[i : i + size], i == 0) for i in range(0, len(code), size)]
            assert repair.join_blocks(blocks)[0] == cost and "".join(repair.join_blocks(blocks)[1]) == audit, (k, size, code)


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(80):
        for turn, (role, text) in enumerate(talk(rng, rng.choice([0, 1, 2, 5, 9, 30]))):
            rows.append((conv, turn if rng.random() > 0.05 else None, role if rng.random() > 0.05 else None, text if rng.random() > 0.05 else None, "x", "y"))
    rows += [(None, 1, "user", "Hi.", "x", "y"), (None, 3, "assistant", "Ho", "x", "y"), (None, 3, "assistant", "Ho", "x", "y")]
    rows += [(k, 0, "user", "Only one.", "x", "y") for k in range(1000, 1060)]
    return spark.createDataFrame(rows, TURNS).cache()


def expected(rows):
    """The contract's columns of rows (conv_id, turn, role, text) after damage, by conv_id."""
    talks = {}
    for conv, turn, role, text, *_ in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = talks.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = {}
    for conv, own in talks.items():
        own.sort(key=lambda r: (r[:2], r[2].encode(), r[3].encode()))
        cost, audit, repaired, faults = brute([r[2:] for r in own])
        numbers = [t for there, t, _, _ in own if there]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        sha = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query(spark, turns, tmp_path):
    folder = f"file://{tmp_path}"
    turns.write.parquet(f"{folder}/conversations.parquet")
    got = repair.op11(spark, folder).collect()
    want = expected([tuple(r) for r in turns.collect()])
    assert len(got) == len(want) and {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want
    turns.limit(0).write.parquet(f"{folder}/none/conversations.parquet")
    assert repair.op11(spark, f"{folder}/none").count() == 0


def test_blocks_of_a_long_conversation(spark):
    rng = random.Random(8)
    rows = [(7, k, role, text, "", "") for k, (role, text) in enumerate(talk(rng, 90))]
    cost, audit, repaired, _ = brute([r[2:4] for r in rows])
    for block in (4, 256):
        fixed = repair.Repair(spark.createDataFrame(rows, TURNS), block)
        found = fixed.report.collect()
        assert [(r["cost"], r["audit"], r["turns"]) for r in found] == [(cost, audit, 90)]
        told = fixed.turns().collect()
        assert [f"{r['role']}:{r['text']}" for r in told] == list(repaired) and [r["place"] for r in told] == list(range(len(told)))
        assert "".join(r["edit"] for r in told) == audit.replace("D", "")
