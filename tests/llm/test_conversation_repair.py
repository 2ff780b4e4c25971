"""Repairs against a search of all short edit strings, and damage against zlib."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from factloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def brute(rows):
    """(cost, audit, repaired rows) of rows [(role, text, gone, cut)]: best first over (cost, audit), by role strings."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        if not re.fullmatch("s?(ua)*u?", roles) or (i, roles, audit) in seen or len(audit) > 2 * len(rows) + 4:
            continue
        seen.add((i, roles, audit))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + name[0], (*out, (name, ""))))
        if i == len(rows):
            continue
        role, text, gone, cut = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, out))
        if not gone:
            heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, roles + (role[:1] or "?"), (*out, (role, text))))
            for name in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, roles + name[0], (*out, (name, text))))


def plain(conversations):
    """Every output row by plain code (without the search where rows are many)."""
    out = {}
    for conv in {c for c, *_ in conversations}:
        rows = []
        for c, turn, role, text, _ in conversations:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, coded, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            last = text.rstrip(" \t\n\x0b\f\r")[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            coded.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        turns = {t for t, *_ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, made = brute(coded)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def test_every_kind_of_conversation(spark):
    rnd = random.Random(5)
    texts = ["Yes.", "No", "What?", "  ", "", None, "Well! \n", "Ends so...", "é ü 🎉.", " "]
    rows = []
    for conv in [*range(60), None]:
        for k in range(rnd.randrange(1, 7)):
            turn = None if rnd.random() < 0.1 else k * rnd.choice([1, 1, 2]) - 3
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system", "user", "assistant", None, "", "User"]), rnd.choice(texts), 1))
    rows += [(900, 2, "user", "Tie.", 0), (900, 2, "user", "Tie.", 0), (900, 2, "assistant", "Tie.", 0), (901, 1, "user", "x" * 200_000 + ".", 0)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in cr.damage_and_repair(table).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("segment", [1, 2, 5])
def test_segments_join(monkeypatch, segment):
    rnd = random.Random(segment)
    for _ in range(150):
        codes = bytes(rnd.choice([0, 1, 2, 3, 5, 6, 8, 9, 10]) for _ in range(rnd.randrange(9)))
        monkeypatch.setattr(cr, "SEGMENT", 1 << 16)
        whole = cr.cheapest(codes)
        monkeypatch.setattr(cr, "SEGMENT", segment)
        assert cr.cheapest(codes) == whole
        rows = [(cr.INITIALS[c & 3] or "x", "t", bool(c & cr.GONE), bool(c & cr.CUT)) for c in codes]
        assert whole == brute(rows)[:2]


def test_no_rows(spark):
    assert cr.damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = cr.damage_and_repair(spark.createDataFrame([(dropped, 0, "user", "Gone.", 1)], SCHEMA)).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation(spark):
    """One conversation of many rows: bytes in memory, texts as a stream."""
    rows = spark.range(60_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('Text ', id, '.') as text")
    row = cr.damage_and_repair(rows).first()
    assert row.duplicate > 2000 and row.cost > 0 and row.audit.count("K") > 40_000
