"""Conversation repair against plain versions."""

import hashlib
import os
import random
import zlib
from itertools import product

import duckdb
import pytest

from matchloom.llm import turns

COSTS = {"D": 2, "I": 5, "K": 0, "R": 1}


def grammar(length):
    return None if length == 1 else "s" * (length % 2) + "ua" * (length // 2)


def plain(rows):
    """(cost, audit) by a full table of strings for each length; rows are (initial, must go, extra)."""
    best = None
    for length in range(2 * len(rows) + 4):
        target = grammar(length)
        if target is None:
            continue
        table = {}
        for i in range(len(rows), -1, -1):
            for j in range(length, -1, -1):
                ways = [(0, "")] if i == len(rows) and j == length else []
                if i < len(rows):
                    c, a = table[i + 1, j]
                    ways.append((c + 2, "D" + a))
                if j < length and target[j] != "s":
                    c, a = table[i, j + 1]
                    ways.append((c + 5, "I" + a))
                if i < len(rows) and j < length and not rows[i][1]:
                    c, a = table[i + 1, j + 1]
                    if rows[i][0] == target[j]:
                        ways.append((c + rows[i][2], "K" + a))
                    elif target[j] != "s":
                        ways.append((c + rows[i][2] + 1, "R" + a))
                table[i, j] = min(ways, default=(10**9, ""))
        best = table[0, 0] if best is None else min(best, table[0, 0])
    return best


def test_every_short_conversation():
    for n in range(4):
        for codes in product(range(16), repeat=n):
            want = plain([turns._turn(c) for c in codes])
            assert turns.align(bytes(codes)) == want and turns.fold(bytes(codes)) == want


def test_random_conversations_and_folded_lengths():
    rng = random.Random(3)
    for _ in range(150):
        codes = bytes(rng.choice((0, 4, 8, 12, 4, 8, 4, 8, 5, 6, 7, 11)) for _ in range(rng.randint(4, 16)))
        assert turns.align(codes) == turns.fold(codes) == plain([turns._turn(c) for c in codes])
    for n in (100, 400, 1000):
        codes = bytes(rng.choice((4, 8, 4, 8, 4, 8, 0, 7, 11, 5)) for _ in range(n))
        assert turns.align(codes) == turns.fold(codes)


def whole(rows):
    """The contract in plain Python over (conv_id, turn, role, text)."""
    one = lambda x: " " if x is None else str(x)
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        role, text, kind = one(role), one(text), zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        convs.setdefault(conv, []).extend([] if kind == 0 else [(turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text)] * (2 if kind == 3 else 1))
    for conv, held in convs.items():
        held.sort()
        seen, faults, coded = set(), [], []
        for _, _, role, _, text in held:
            bare = text.strip(" \t\n\v\f\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            faults.append(fault)
            coded.append((role[:1] if role[:1] in ("s", "u", "a") else "-", fault in (1, 2), 5 * (fault == 3)))
        known = [t for k, t, *_ in held if k]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        cost, audit = plain(coded)
        target, lines, i, j = grammar(len(audit) - audit.count("D")), [], 0, 0
        for op in audit:
            if op != "D":
                role = held[i][2] if op == "K" else {"u": "user", "a": "assistant"}[target[j]]
                lines.append(f"{role}:{'' if op == 'I' else held[i][4]}")
                j += 1
            i += op != "I"
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in turns.repair_conversations(df).collect()}


def test_whole_table_against_plain_version_and_sql(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = results(df)
    assert got == whole([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    columns = ["conv_id", *turns.COUNTS, "audit", "repaired_sha256"]
    assert {r[0]: r[1:] for r in con.execute(f"SELECT {', '.join(columns)} FROM ({turns.ORACLE})").fetchall()} == got


def test_odd_rows(spark):
    rng = random.Random(5)
    say = ["Yes.", "no", "", " ", None, "Oh!\n", "x" * 200_000 + "?", "end ", "tab.\t", "ﬁn.", "𝄞"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "unknown"]), rng.choice(say)) for c in (*range(8), None) for t in (None, None, *range(5), 3, 9)]
    rows += [(20, 1, "user", "Same.")] * 3 + [(30, t, "user" if t % 2 else "assistant", f"Line {t}.") for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = whole([r for r in rows if r[0] != 30])
    got = results(df.selectExpr("*", "'x' as audit", "1 as cost", "2 as code", "3 as print"))
    long = got.pop(30)
    assert got == want
    assert long[5] > 0 and len(long[6]) >= 1500 and results(df.repartition(7))[30] == long
    assert results(df.filter("conv_id = 20 and turn > 5")) == {}
    dropped = next(c for c in range(100, 400) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    alone = spark.createDataFrame([(dropped, 1, "user", "Hi.")], df.schema)
    assert results(alone) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
