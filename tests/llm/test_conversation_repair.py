"""Conversation repair against a search over all edits, and on odd rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from sievework.llm import conversation_repair as repair

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines; rows: turn, role, text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    # Every sequence of edits in order of (cost, audit), until one gives a sequence of the grammar.
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, said, lines = heapq.heappop(queue)
        if (at, said, audit) in done:
            continue
        done.add((at, said, audit))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            return gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, lines
        if not re.fullmatch("s?(ua)*u?", said):
            continue
        for x, role in (("u", "user"), ("a", "assistant")):
            heapq.heappush(queue, (cost + 2, audit + "I", at, said + x, (*lines, f"{role}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, said, lines))
            if faults[at] not in (1, 2):
                more = faults[at] == 3
                heapq.heappush(queue, (cost + more, audit + "K", at + 1, said + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for x, new in (("u", "user"), ("a", "assistant")):
                    heapq.heappush(queue, (cost + 2 + more, audit + "R", at + 1, said + x, (*lines, f"{new}:{text}")))


def found(spark, rows, present=None):
    got = repair.repair(rows, present)
    lines = {}
    for r in sorted(got.rows.collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    digests = {r["conv_id"]: r["sha256"] for r in repair.digests(got.rows).collect()}
    assert digests == {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in lines.items()}
    return {r["conv_id"]: (*tuple(r)[1:], tuple(lines.get(r["conv_id"], ()))) for r in got.summary.collect()}


def test_against_all_edits(spark):
    draw = random.Random(5)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", "sys", "User"], ["ok.", "well!", "no end", "", " \t", "a?", "a? \n", "b. "]
    rows = []
    for conv in range(150):
        rows += [(conv, draw.choice([None, *range(6)]) if draw.random() < 0.4 else t, draw.choice(roles[: draw.choice([2, 3, 9])]), draw.choice(texts)) for t in range(draw.randint(0, 6))]
    rows += [(None, 0, "assistant", "x."), (None, 0, "assistant", "x."), (900, None, None, None), (901, None, "user", "q.")]
    rows += [(902, t, "user", "same.") for t in range(4)]
    draw.shuffle(rows)
    clash = {n: F.lit(1) for n in ("at", "fault", "_turn", "place", "edit", "_at", "_there", "cost")}
    got = found(spark, spark.createDataFrame(rows, ROWS).repartition(4).withColumns(clash))
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {k: brute(v) for k, v in by.items()}


def test_long_conversation(spark):
    """Thousands of rows: edits are sent off as soon as all readings share them."""
    draw = random.Random(6)
    rows = [(1, t, draw.choice(["user", "assistant"]), f"{t}{draw.choice(['.', '', '!'])}") for t in range(6000)]
    parse = repair.Parse()
    for _, _, role, text in rows:
        parse.row(role[0], 0 if text[-1] in ".!" else 3)
    assert len(parse.shared()) > 5900
    got = found(spark, spark.createDataFrame(rows, ROWS))[1]
    kept = re.sub("I|D", "", got[6])
    assert len(re.sub("I", "", got[6])) == 6000
    assert len(got[7]) == len(kept) + got[6].count("I")
    assert re.fullmatch("(ua)+", "".join(x[0] for x in got[7]))
    price = {"K": 0, "R": 2, "D": 3, "I": 2}
    letters = got[6].replace("I", "")
    assert got[5] == sum(price[x] for x in got[6]) + sum(x != "D" and r[3][-1] not in ".!" for x, r in zip(letters, rows, strict=True))


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(60) for t, (r, x) in enumerate([("system", "s. t"), ("assistant", "a!b?"), (None, None)])] + [(None, None, "user", "x.")]
    got = sorted((tuple(r) for r in repair.damage(spark.createDataFrame(rows, ROWS)).collect()), key=str)
    want = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else show(role), "" if kind == 1 else re.sub("[.!?]", "", show(text)) if kind == 2 else show(text)
        want += [(conv, turn, role, text, kind != 0)] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=str)


def test_absent_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x."), (1, 1, "user", "x."), (2, 0, "user", "y."), (2, 3, "assistant", "z.")], ROWS)
    got = found(spark, rows, F.col("conv_id") == 2)
    assert got == {1: (0, 0, 0, 0, 0, 0, "", ()), 2: (2, 0, 0, 0, 0, 0, "KK", ("user:y.", "assistant:z."))}
    assert found(spark, rows.limit(0)) == {}


@pytest.mark.parametrize("conv_type", ["string", "int"])
def test_id_types(spark, conv_type):
    rows = spark.createDataFrame([(1, 0, "user", "x.")], ROWS).withColumn("conv_id", F.col("conv_id").cast(conv_type))
    assert found(spark, rows) == {("1" if conv_type == "string" else 1): (0, 0, 0, 0, 0, 2, "KI", ("user:x.", "assistant:"))}
