"""Phrase mining against plain counts."""

import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import phrases

COLUMNS = "lang rank phrase a l r n score".split()


def plain(rows, least=30, report=2000):
    """The contract with a counter over all phrases; rows are (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        found = []
        for p, a in often.items():
            if 100 * around[p] < 80 * a:
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:report])]
    return sorted(out)


def results(df, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(df, **options).collect())


def test_whole_table_against_plain_version_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = results(docs)
    assert got and got == plain([(r.text, r.lang) for r in docs.select("text", "lang").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({phrases.ORACLE})").fetchall()) == got


def test_partitions_equal_counts():
    rng = np.random.default_rng(1)
    for n, words in ((1, 1), (50, 2), (3000, 7), (3000, 400)):
        rows = rng.integers(0, words, (n, 4)).astype(np.int32)
        for k in range(2, 4):
            rows[rng.random(n) < 0.2, k:] = -1
        rows = np.unique(rows, axis=0)
        times = rng.integers(1, 9, len(rows))
        want = Counter()
        for row, t in zip(rows.tolist(), times.tolist()):
            for d in range(1, 5):
                if row[d - 1] >= 0:
                    want[tuple(row[:d])] += t
        for least in ((1,) * 4, (12,) * 4, (1, 1, 1, 9)):
            row, depth, total = phrases.partitions(rows, times, least)
            assert {tuple(rows[r, :d].tolist()): t for r, d, t in zip(row, depth, total)} == {p: c for p, c in want.items() if c >= least[len(p) - 1]} and len(row) == len(set(zip(row, depth)))


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "x\x0by", "a.b", "ſ", "K", " ", "日本"]
    rows = [(" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 60))), rng.choice(["en", "en", "en", "de", None])) for _ in range(900)]
    rows += [("Click Here " + str(rng.random()) + " now", "en") for _ in range(400)] + [("all rights reserved, all rights reserved", "fr")] * 200
    rows += [(None, "en"), ("", "fr"), (" . ", None), ("\t\r\n", "xx"), ("long tail " * 60_000 + "z" * 100_000, "en")]
    return rows, spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as shard", "2 as n", "'x' as phrase").repartition(5)


def test_odd_rows_and_small_shards(mixed):
    rows, df = mixed
    want = plain(rows)
    assert {r[0] for r in want} >= {"en", "de", "fr", "und"}
    assert results(df) == want
    assert results(df, shard_rows=300) == want
    assert results(df, shard_rows=2000, split_rows=50) == want
    assert results(df.filter("text = 'none'")) == []


def test_a_text_sent_in_several_parts(mixed, monkeypatch):
    """Suffixes reach over the places where a task sends off what it holds; rare pairs end them."""
    rows = [(t, lang or "und") for t, lang in mixed[0][:120]]
    monkeypatch.setattr(phrases, "HELD_WORDS", 50)
    monkeypatch.setattr(phrases, "SLICE", 64)
    of = lambda lang, w: np.array([phrases.xxhash.xxh64_intdigest(w.encode(), phrases.xxhash.xxh64_intdigest(lang.encode(), 42))], np.uint64)
    pair = lambda lang, a, b: int(phrases.pair_hash(of(lang, a), of(lang, b))[0])
    bits = np.full((1 << phrases.SIEVE_BITS) // 8, 255, np.uint8)
    for lang in ("en", "de", "und"):
        spot = pair(lang, "w1", "w0") & ((1 << phrases.SIEVE_BITS) - 1)
        bits[spot // 8] &= ~np.uint8(1 << spot % 8)
    sieve = SimpleNamespace(value=bits.tobytes())
    batch = pa.record_batch([pa.array([t for t, _ in rows]), pa.array([lang for _, lang in rows])], names=["text", "lang"])
    found, shards = Counter(), {}
    for out in phrases._route(3, sieve, [batch]):
        for r in out.to_pylist():
            words, places, times = phrases.unpack(r["blob"])
            for p, t in zip(places.tolist(), times.tolist()):
                found[(r["lang"], *(words[i] for i in p if i >= 0))] += t
    for out in phrases._tally(3, [batch]):
        shards.setdefault((out["shard"][0].as_py(), out["lang"][0].as_py()), []).append(out)
    counted = Counter()
    for key, parts in shards.items():
        for r in phrases._sum(7, [pa.scalar(k) for k in key], pa.Table.from_batches(parts)).to_pylist():
            counted[r["lang"], r["word"] if r["pair"] is None else r["pair"]] += r["n"]
    want, single = Counter(), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            single.update((lang, x) for x in [*w, *[None] * len(w)])
            single.update((lang, pair(lang, a, b)) for a, b in zip(w, w[1:]))
            runs = [[]]
            for x in w:
                runs += [[]] if runs[-1][-1:] == ["w1"] and x == "w0" else []
                runs[-1].append(x)
            want.update((lang, *(x.encode() for x in run[i : i + 4])) for run in runs for i in range(len(run) - 1))
    assert found == want and counted == Counter({k: n for k, n in single.items() if n >= 7 or k[1] is None})
