"""Conversation structure repair: damage, faults, and the cheapest edits to an alternating grammar.

The roles of a repaired conversation are ``(s?(ua)+)?``. Its turns are aligned to the grammar's string
of each feasible length (Wagner and Fischer); strings of all lengths share their tails, so that one
table of turns by characters left serves them all. The cost of a first, greedy repair bounds the table
to a band around the diagonal (Ukkonen); the cheapest lengths are traced back and their audits compared.

Everything that looks at texts is done by DataFrame functions. A conversation is then a string with one
letter a turn, and tasks stream over sorted rows: they hold a few bytes a turn of one conversation and
never its texts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed costs.
RETYPE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Turns from which on lengths that end alike are aligned together, in time and memory linear in the turns.
FOLD = 1024
ROLES, FAULTS = "sua", ("ok", "blank", "duplicate", "truncated")
VISIBLE = r"[^\x20\x09-\x0D]"
NAMES = {"u": "user", "a": "assistant"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FAR = 1 << 40


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) of the damaged turns; a dropped turn stays as a row with a null copy.

    Nulls of role and text, and in the hashed key, are one space.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 0, F.array(F.lit(None).cast("int"))).when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    """Conversations whole in one partition, their turns in order: nulls first, ties by role, text hash and copy."""
    return rows.sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "print", "copy")


def coded(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, print, copy, code): one letter for the role's initial and the first fault of a turn.

    Turns with the role and text of an earlier one are told by hashes, so no text is shuffled.
    """
    seen = F.regexp_extract("text", rf"({VISIBLE})[\x20\x09-\x0D]*\z", 1)
    initial = F.left("role", F.lit(1))
    narrow = turns.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("print"), "copy", seen.alias("last"), initial.alias("initial"))
    place = Window.partitionBy("conv_id", "role", "print", F.col("copy").isNull()).orderBy(F.col("turn").asc_nulls_first(), "copy")
    fault = F.when(F.col("last") == "", 1).when(F.row_number().over(place) > 1, 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    kind = F.when(F.col("initial").isin(*ROLES), F.instr(F.lit(ROLES), F.col("initial")) - 1).otherwise(3)
    return narrow.repartition("conv_id").withColumn("code", F.when(F.col("copy").isNotNull(), kind * 4 + fault))


@lru_cache(maxsize=1 << 15)
def repair(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits; codes are those of :func:`coded`. No turns: 0 and an empty audit."""
    return fold(codes) if len(codes) > FOLD else align(codes)


def _turn(code: int) -> tuple[str, bool, int]:
    """Initial, whether the turn must go, and what it costs to leave it."""
    return "sua-"[code >> 2], code & 3 in (1, 2), CUT_OFF * (code & 3 == 3)


def greedy(codes: bytes) -> int:
    """The cost of one valid repair: what must go goes, other turns take the role that is due."""
    cost, due = 0, "u"
    for initial, gone, extra in map(_turn, codes):
        if gone or extra or initial == "s":
            cost += DELETE
        else:
            cost += RETYPE * (initial != due)
            due = "a" if due == "u" else "u"
    return min(cost + INSERT * (due == "a"), DELETE * len(codes))


def align(codes: bytes) -> tuple[int, str]:
    """The cheapest alignment over all feasible lengths, the ASCII-least audit among equals."""
    n, most = len(codes), greedy(codes)
    turns = [_turn(c) for c in codes]
    lasting = np.zeros(n + 1, np.int64)
    lasting[:n] = np.cumsum([not gone for _, gone, _ in turns][::-1])[::-1]
    # table[i][r]: cost of aligning the turns from i on to the last r characters of uaua...ua. Beyond the band a path
    # costs more than the incumbent, by the deletions or insertions alone that it needs.
    width = int(lasting[0]) + most // INSERT + 2
    at = np.arange(width)
    table = np.full((n + 1, width), FAR)
    table[n] = INSERT * at
    low = lambda i: max(0, int(lasting[i]) - most // DELETE)
    high = lambda i: min(width, int(lasting[i]) + most // INSERT + 1)
    table[n, high(n) :] = FAR
    for i in range(n - 1, -1, -1):
        initial, gone, extra = turns[i]
        a, b = low(i), high(i)
        best = table[i + 1, a:b] + DELETE
        if not gone:
            due = np.where(at[a:b] % 2 == 0, initial != "u", initial != "a") * RETYPE + extra
            before = table[i + 1, a - 1 : b - 1] if a else np.concatenate([[FAR], table[i + 1, : b - 1]])
            best = np.minimum(best, before + due)
        table[i, a:b] = np.minimum.accumulate(best - INSERT * at[a:b]) + INSERT * at[a:b]
    # With an s in front: the turn that it comes from, all earlier ones deleted.
    even = range(0, width, 2)
    cost = {(r, None): int(table[0, r]) for r in even}
    for i, (initial, gone, extra) in enumerate(turns):
        if initial == "s" and not gone:
            for r in even[1:]:
                cost[r, i] = DELETE * i + extra + int(table[i + 1, r])
    least = min(cost.values())
    audits = (_trace(turns, table, r, s) for (r, s), c in cost.items() if c == least)
    return least, min(audits)


def _trace(turns, table, r: int, s: int | None) -> str:
    """The ASCII-least audit to the last r characters, after an s kept from turn s."""
    i, out = (0, []) if s is None else (s + 1, ["D" * s + "K"])
    n = len(turns)
    while i < n or r:
        now = table[i, r]
        if i < n and table[i + 1, r] + DELETE == now:
            out.append("D")
            i += 1
        elif r and table[i, r - 1] + INSERT == now:
            out.append("I")
            r -= 1
        else:
            out.append("K" if turns[i][0] == ("u" if r % 2 == 0 else "a") else "R")
            i, r = i + 1, r - 1
    return "".join(out)


def fold(codes: bytes) -> tuple[int, str]:
    """As :func:`align`, with all lengths whose strings go on alike in one cell: start, u due after s, a due, u due or end."""
    n = len(codes)
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = np.full((n + 1, 4), FAR)
    best[n] = 0, 2 * INSERT, INSERT, 0
    rows = best.tolist()
    for i in range(n - 1, -1, -1):
        initial, gone, extra = _turn(codes[i])
        below, now = rows[i + 1], rows[i]
        for q in range(4):
            now[q] = below[q] + DELETE
            if not gone:
                for role, to in after[q].items():
                    if role != "s" or initial == "s":
                        now[q] = min(now[q], below[to] + extra + RETYPE * (initial != role))
        # Two insertions in a row lead back to where they began.
        now[0], now[1], now[2], now[3] = min(now[0], now[2] + INSERT), min(now[1], now[2] + INSERT), min(now[2], now[3] + INSERT), min(now[3], now[2] + INSERT)
    out, q, i = [], 0, 0
    while i < n or rows[i][q]:
        now, initial = rows[i][q], _turn(codes[i])[0] if i < n else ""
        step = 3 if q == 2 else 2
        if i < n and rows[i + 1][q] + DELETE == now:
            out.append("D")
            i += 1
        elif rows[i][step] + INSERT == now:
            out.append("I")
            q = step
        else:
            extra = _turn(codes[i])[2]
            keep = after[q].get(initial)
            same = keep is not None and rows[i + 1][keep] + extra == now
            out.append("K" if same else "R")
            q, i = keep if same else step, i + 1
    return rows[0][0], "".join(out)


def _by_conversation(batches, columns: int):
    """(conv_id, its columns as lists), batch by batch and in order; a conversation may come in several parts."""
    for batch in batches:
        held = [batch.column(k).to_pylist() for k in range(columns)]
        ids, n = held[0], batch.num_rows
        cuts = [0, *(i for i in range(1, n) if ids[i] != ids[i - 1]), n]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield ids[a], [x[a:b] for x in held[1:]]


_NONE = object()


def _examine(batches):
    """Rows of conv_id, COUNTS and audit from sorted rows (conv_id, turn, code)."""
    schema, rows, key = None, [], _NONE

    def close():
        text = bytes(codes)
        cost, audit = repair(text)
        faults = [sum(c & 3 == k for c in text) for k in (1, 2, 3)]
        follow = sum((a >> 2, b >> 2) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(text[:-1], text[1:]))
        gaps = 0 if first is None else last - first + 1 - distinct
        rows.append((key, gaps, *faults, follow, cost, audit))

    def flush():
        out = [pa.array([r[k] for r in rows], schema.field(0).type if k == 0 else pa.string() if k == 7 else pa.int64()) for k in range(8)]
        rows.clear()
        return pa.RecordBatch.from_arrays(out, names=["conv_id", *COUNTS, "audit"])

    def watched():
        nonlocal schema
        for batch in batches:
            schema = batch.schema
            yield batch

    codes, first, last, distinct = bytearray(), None, None, 0
    for conv, (turns, letters) in _by_conversation(watched(), 3):
        if key is _NONE or conv != key:
            if key is not _NONE:
                close()
            key, codes, first, last, distinct = conv, bytearray(), None, None, 0
            if len(rows) >= 4096:
                yield flush()
        for turn, code in zip(turns, letters):
            if code is not None:
                codes.append(code)
                if turn is not None and turn != last:
                    first, last, distinct = turn if first is None else first, turn, distinct + 1
    if key is not _NONE:
        close()
        yield flush()


def _rewrite(batches):
    """Add the hash of the repaired conversation to rows that lead their conversation's turns."""
    names = ["conv_id", *COUNTS, "audit"]
    done, schema, state = [], None, None

    def line(role: str, text: str) -> None:
        digest, sep = state["digest"], b"\n" if state["any"] else b""
        state["any"] = True
        digest.update(sep + f"{role}:{text}".encode("utf-8", "surrogatepass"))

    def inserts() -> None:
        audit = state["audit"]
        while state["at"] < len(audit) and audit[state["at"]] == "I":
            take("user" if state["due"] == "u" else "assistant", "")

    def take(role: str, text: str) -> None:
        line(role, text)
        state["at"] += 1
        state["due"] = "a" if role[0] == "u" else "u"

    def close() -> None:
        inserts()
        done.append((*state["row"], state["digest"].hexdigest()))

    def flush():
        out = [pa.array([r[k] for r in done], schema.field(0).type if k == 0 else pa.string() if k >= 7 else pa.int64()) for k in range(9)]
        done.clear()
        return pa.RecordBatch.from_arrays(out, names=[*names, "repaired_sha256"])

    for batch in batches:
        schema = batch.schema
        held = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*names, "role", "text")]
        for *row, role, text in zip(*held):
            if row[7] is not None:
                if state:
                    close()
                    if len(done) >= 4096:
                        yield flush()
                state = {"row": row, "audit": row[7], "at": 0, "due": "u", "any": False, "digest": hashlib.sha256()}
                continue
            inserts()
            edit = state["audit"][state["at"]]
            if edit == "D":
                state["at"] += 1
            else:
                take(role if edit == "K" else "user" if state["due"] == "u" else "assistant", text)
    if state:
        close()
        yield flush()


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id after damage.

    Null conv_ids are one conversation. Turns of equal number go by role and text hash; null turns come
    first. A role without a letter fits no place of the grammar. A conversation without a turn left has
    zeros, an empty audit and the hash of an empty string; repeated rows are turns of their own, found as
    duplicates. Texts of any length are read whole; other columns are ignored; no rows give no rows.
    A conversation's hash is defined over its lines in order, so one task reads it, as a stream.
    """
    turns = damage(conversations)
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    found = _ordered(coded(turns)).select("conv_id", "turn", "code").mapInArrow(_examine, f"conv_id {id_type}, {counts}, audit string")
    void = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = found.select("*", F.lit(0).alias("is_turn"), void("turn", "long"), void("role", "string"), void("text", "string"), void("print", "string"), void("copy", "int"))
    texts = turns.filter("copy is not null").select("conv_id", *(void(c, "long") for c in COUNTS), void("audit", "string"), F.lit(1).alias("is_turn"), F.col("turn").cast("long").alias("turn"), "role", "text", F.md5(F.col("text").cast("binary")).alias("print"), "copy")
    streams = _ordered(heads.unionByName(texts).repartition("conv_id"), "is_turn")
    return streams.select("conv_id", *COUNTS, "audit", "role", "text").mapInArrow(_rewrite, f"conv_id {id_type}, {counts}, audit string, repaired_sha256 string")


def _oracle() -> str:
    """The same in DuckDB: a recursive alignment, turn by turn from the last, over the four states of the grammar."""
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(k) + 1), lambda i: ascii(substr(k, i::INT, 1))::BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295)"
    pick = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    put = lambda op, cost, s: f"{{'c': {s}.c + {cost}, 'a': '{op}' || {s}.a}}"

    def step(q, moves):
        out = [put("D", DELETE, f"s{q}")]
        for role, to in moves:
            out.append(f"CASE WHEN fault IN (1, 2) OR initial <> '{role}' THEN {{'c': {FAR}, 'a': ''}} ELSE {put('K', 'extra', f's{to}')} END")
            if role != "s":
                out.append(f"CASE WHEN fault IN (1, 2) OR initial = '{role}' THEN {{'c': {FAR}, 'a': ''}} ELSE {put('R', f'extra + {RETYPE}', f's{to}')} END")
        return pick(*out) + f" AS n{q}"

    steps = ", ".join([step(0, [("s", 1), ("u", 2)]), step(1, [("u", 2)]), step(2, [("a", 3)]), step(3, [("u", 2)])])
    inserted = ", ".join(f"{pick(f'n{q}', put('I', INSERT, f'n{to}'))} AS s{q}" for q, to in ((0, 2), (1, 2), (2, 3), (3, 2)))
    return f"""
    WITH RECURSIVE bits AS (SELECT range AS v, 0 AS n, range AS first FROM range(256) UNION ALL SELECT xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), n + 1, first FROM bits WHERE n < 8),
    crc AS (SELECT list(v ORDER BY first) AS tab FROM bits WHERE n = 8),
    raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    hit AS (SELECT conv_id, turn, role, text, {crc} % 20 AS kind FROM raw, crc),
    rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM rows),
    told AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{VISIBLE}') THEN 1 WHEN again > 1 THEN 2 WHEN regexp_extract(text, '({VISIBLE})[\\x20\\x09-\\x0D]*\\z', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM placed),
    t AS (SELECT *, CASE WHEN fault = 3 THEN {CUT_OFF} ELSE 0 END AS extra FROM told),
    dp AS (SELECT conv_id, max(n) + 1 AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': {2 * INSERT}::BIGINT, 'a': 'II'}} AS s1, {{'c': {INSERT}::BIGINT, 'a': 'I'}} AS s2, {{'c': 0::BIGINT, 'a': ''}} AS s3 FROM t GROUP BY conv_id
      UNION ALL SELECT conv_id, i, {inserted} FROM (SELECT d.conv_id, t.i, {steps} FROM dp d JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.i - 1)),
    best AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM dp WHERE i = 1),
    edits AS (SELECT conv_id, p, substr(audit, p::INT, 1) AS op, len(replace(left(audit, p::INT), 'I', '')) AS i, len(replace(left(audit, p::INT), 'D', '')) AS o, len(replace(audit, 'D', '')) AS total FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM best)),
    lines AS (SELECT e.conv_id, p, CASE WHEN op = 'K' THEN t.role WHEN (total - o) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE t.text END AS line FROM edits e LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i WHERE op <> 'D'),
    texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS text FROM lines GROUP BY conv_id),
    stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND was || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id),
    ids AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(texts.text, '')) AS repaired_sha256
    FROM ids LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM ids.conv_id"""


ORACLE = _oracle()
