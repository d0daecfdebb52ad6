"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns."""

import collections
import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from matchloom.llm import bpe, hnsw, langid, lines, mixing, mpegts, pii, queries, simhash, suffixes, urls
from matchloom.llm.common import connected_components, documents, sieve

DOCS = "doc_id long, text string, lang string, source string, fp long, component string, n_lines long, size string, score string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "a", 1, "c", 5, "s", "x") for d, t in rows], DOCS)


ODD = [(1, None), (2, ""), (None, "no id at all in this row"), (3, "word"), (4, "same text twice here"), (4, "same text twice here"), (5, "long " * 30_000), (6, "a\x00b  \n\t c"), (7, "naïve 日本語 \U0001f600 <|endoftext|> end")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def data(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


# 1: transport streams


@pytest.mark.parametrize("n", [0, 1, 64, 161, 162, 163, 169, 170, 171, 184, 4095, 4096, 4097, 32_768, 36_865])
def test_stream_round_trip(n):
    payload = os.urandom(n)
    media = mpegts.mux(payload)
    found = mpegts.demux(media)
    assert len(media) % 188 == 0 and found["payload"] == payload
    assert (found["sync_errors"], found["cc_errors"]) == (0, 0)
    assert found["programs"] == [(1, 0x1000)] and found["streams"] == [(0x100, 1, 6)]
    units = -(-n // 4096)
    assert found["pts"] == [3600 * i for i in range(units)] and found["access"] == list(range(0, units, 8))


def test_stream_damage():
    media = mpegts.mux(bytes(range(256)) * 64)
    lost = media[: 188 * 5] + media[188 * 6 :]
    assert mpegts.demux(lost)["cc_errors"] == 1
    twice = media[: 188 * 6] + media[188 * 5 :]
    assert mpegts.demux(twice)["payload"] == bytes(range(256)) * 64
    assert mpegts.demux(b"noise" + media)["payload"] == bytes(range(256)) * 64
    assert mpegts.demux(b"")["packets"] == 0 and mpegts.demux(b"x" * 500)["packets"] == 0


def test_media_features(odd, empty):
    got = mpegts.media_features(odd).collect()
    assert len(got) == len(ODD)
    want = collections.Counter((d, len((t or "").encode()), len(data(t)), hashlib.sha256(data(t)).hexdigest(), zlib.crc32(data(t)[-64:])) for d, t in ODD)
    assert want == collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    assert all(r.media_sha256 == hashlib.sha256(mpegts.mux(data(t))).hexdigest() for r in got for d, t in ODD if d == r.doc_id)
    assert mpegts.media_features(empty).collect() == []


# 2: suffix arrays


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        cover = np.zeros(len(x), dtype=bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(b for b, c in zip(x, cover) if not c)
        out.append((len(x), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 2_000])
def test_suffix_arrays(spark, shard_bytes):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abé", k=rng.randint(1, 4)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(3)]
    texts = [None, "", "zz" * 70, "y" * 40, "y" * 41, *(shared[rng.randrange(3)] + word() * 9 + (shared[rng.randrange(3)] if rng.random() < 0.5 else "") + word() * 20 for _ in range(60))]
    texts += [texts[9], texts[9][:-1]]
    docs = table(spark, list(enumerate(texts)))
    got = suffixes.remove_repeats(docs, length=40, gram=8, shard_bytes=shard_bytes).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == plain_repeats(texts, 40)


def test_suffix_arrays_of_one_passage_in_many_texts(spark, monkeypatch):
    """Segments of one anchor with different neighbours bring a few rows each to the shards, not one a window."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefghi ", k=n))
    passage, seen = word(70), {}
    texts = [word(rng.randrange(60, 90)) + passage + word(rng.randrange(60, 90)) for _ in range(150)] + [passage, passage[:39], passage[3:45]]
    keep = suffixes.materialize
    monkeypatch.setattr(suffixes, "materialize", lambda df, label: seen.setdefault(label, keep(df, label)) if label == "repeat-local" else keep(df, label))
    got = suffixes.remove_repeats(table(spark, list(enumerate(texts))), length=40, gram=8, shard_bytes=5_000).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == plain_repeats(texts, 40)
    assert seen["repeat-local"].count() < 4 * len(texts)
    # What the texts of a core hold is too much for a shard, too.
    got = suffixes.remove_repeats(table(spark, list(enumerate(texts))), length=40, gram=8, shard_bytes=200).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == plain_repeats(texts, 40)


def test_text_longer_than_a_part(spark):
    """A text of over CHUNK bytes is read in parts that overlap; repeats over their edges are found."""
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 123, suffixes.CHUNK + 700_000).astype(np.uint8)
    edge, tail = suffixes.CHUNK, len(raw)
    raw[1000:2200] = raw[edge - 600 : edge + 600]
    raw[5000:5450] = raw[tail - 450 : tail]
    # One byte too short, and different bytes on both sides.
    raw[300_000:300_399] = raw[200_000:200_399]
    raw[[199_999, 200_399]], raw[[299_999, 300_399]] = 97, 98
    other = rng.integers(97, 123, 3000).astype(np.uint8)
    other[100:900] = raw[edge - 400 : edge + 400]
    texts = {1: raw.tobytes().decode(), 2: other.tobytes().decode()}
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    gone = {1: [(1000, 2200), (5000, 5450), (edge - 600, edge + 600), (tail - 450, tail)], 2: [(100, 900)]}
    for d, spans in gone.items():
        kept, at = [], 0
        for a, b in spans:
            kept.append(texts[d][at:a])
            at = b
        kept.append(texts[d][at:])
        assert got[d] == (sum(b - a for a, b in spans), len(spans), hashlib.sha256("".join(kept).encode()).hexdigest())


def test_suffix_order():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, 3000, dtype=np.uint8)
    left = np.r_[np.arange(1000, 0, -1), np.arange(2000, 0, -1)]
    order = suffixes.suffix_order(data, left, 2000)
    assert order.tolist() == sorted(range(3000), key=lambda i: (data[i : i + left[i]].tobytes(), i))


def test_suffix_arrays_odd_rows(odd, empty):
    got = suffixes.remove_repeats(odd).collect()
    assert len(got) == len(ODD) and {r.n_removed for r in got if r.doc_id == 5} == {150_000}
    assert suffixes.remove_repeats(empty).collect() == []


# 3: personal data

PRIVATE = [
    (1, "mail a@b.co, x.y+z@q-r.example.org! 4111 1111 1111 1111 and 4111 1111 1111 1112"),
    (2, "host 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5 call +1 (202) 555-0100 or +12 34"),
    (3, "é IBAN GB82 WEST 1234 5698 7654 32 is fine, GB82 WEST 1234 5698 7654 33 is not"),
    (4, None), (5, ""), (None, "a@b@c.de é@x.y a@b.c%x@d.e"), (6, "9" * 5000), (7, "a." * 20_000 + "@x.y"), (7, "0.0.0.0-00000000000000"),
]


def test_personal_data(spark, empty):
    got = {(r.doc_id, r.spans) for r in pii.digest(pii.find(table(spark, PRIVATE))).collect()}

    def luhn(d):
        return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        if kind == "phone":
            return 9 <= len(digits) <= 15
        if kind == "iban":
            c = hit.replace(" ", "")
            return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1
        return True

    plain = lambda text: ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in pii.PLAIN.items() for m in re.finditer(p, text or "") if ok(k, m[0]))
    assert got == {(d, plain(t)) for d, t in PRIVATE}
    assert pii.find(empty).collect() == []


def test_personal_data_context(spark):
    row = pii.find(table(spark, [(1, "my phone is +1 202 555 0100"), (2, "xx yy zz +1 202 555 0100")])).orderBy("doc_id").collect()
    assert row[0].found[0].score > row[1].found[0].score
    digest = pii.digest(pii.find(table(spark, [(1, "my phone is +1 202 555 0100, mail x@y.zz and a@b.cc"), (2, "q")]))).orderBy("doc_id").collect()
    # By kind: "mail" is next to the first address, another hit lies between it and the second; the number has "phone".
    assert [(r.scores, r.n_nearby) for r in digest] == [("100,80,80", 2), ("", 0)]


def test_personal_data_in_time_with_the_hits(spark):
    """Eight times the text takes about eight times as long; all spans are right."""
    text = lambda n: " ".join(f"u{i}@x{i % 7}.org" for i in range(n))
    took = {}
    for n in (4000, 4000, 32_000):
        df = table(spark, [(1, text(n))])
        began = time.perf_counter()
        (row,) = pii.find(df).collect()
        took[n] = time.perf_counter() - began
        assert [(f.start, f.end) for f in row.found] == [m.span() for m in re.finditer(pii.PLAIN["email"], text(n))]
    assert took[32_000] < 16 * took[4000]


# 4: fuzzy lines


def test_fuzzy_lines_in_turns(spark, monkeypatch):
    """Lines and pairs that are too many for one exchange take turns, with the same result."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9)))
    plain = [[word() for _ in range(14)] for _ in range(30)]
    typo = lambda line: " ".join(w[:1] + "z" + w[2:] if k == at else w for at in [rng.randrange(14)] for k, w in enumerate(line))
    docs = table(spark, [(i, "\n".join(typo(plain[(i + 7 * k) % 30]) for k in range(3))) for i in range(45)])
    whole = sorted(lines.dedup_lines(docs).collect())
    keep, seen = lines.materialize, []
    monkeypatch.setattr(lines, "materialize", lambda df, label: (seen.append(label), keep(df, label))[1])
    monkeypatch.setattr(lines, "AT_ONCE", 50)
    assert sorted(lines.dedup_lines(docs).collect()) == whole
    assert sum(r.n_removed for r in whole) == 105
    assert seen.count("line-marks") > 1 and seen.count("line-near") > 1


def test_fuzzy_lines(spark, odd, empty):
    fox = "the quick brown fox jumps over the lazy dog near the old river bank in the morning sun"
    rows = [(1, f"{fox}\nshort\n"), (2, f"Intro line of its own, quite different\n{fox.upper()}!"), (3, fox.replace("dog", "dogs")), (4, None), (5, ""), (None, "another line that nobody else has"), (6, "short")]
    got = {r.doc_id: r for r in lines.dedup_lines(table(spark, rows), distance=12).collect()}
    assert got[1].text == f"{fox}\nshort\n" and got[2].text == "Intro line of its own, quite different" and got[3].text == ""
    assert (got[4].text, got[4].n_lines, got[5].text, got[5].n_lines, got[6].text) == (None, 0, "", 1, "short")
    assert [got[d].n_removed for d in (1, 2, 3, None)] == [0, 1, 1, 0]
    assert len(lines.dedup_lines(odd).collect()) == len(ODD) and lines.dedup_lines(empty).collect() == []


def test_fuzzy_lines_find_edited_lines(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 10)))
    texts = []
    for i in range(150):
        words = [word() for _ in range((5, 8, 12, 20, 40)[i % 5])]
        texts.append(" ".join(words))
        for at in rng.sample(range(len(words)), max(1, len(words) * (i % 4) // 20)):
            words[at] = words[at][:-1] + "zq" if i % 3 else word()
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    pairs = df.alias("a").join(df.alias("b"), F.expr("a.id < b.id and levenshtein(a.t, b.t) <= floor(0.2D * greatest(length(a.t), length(b.t)))"))
    want = {r.b for r in pairs.select(F.col("b.id").alias("b")).collect()}
    got = {r.doc_id for r in lines.dedup_lines(table(spark, list(enumerate(texts)))).filter("n_removed > 0").collect()}
    assert len(want) > 120 and got <= want and len(got) >= 0.97 * len(want)


def test_fuzzy_lines_beyond_ascii(spark):
    plain = 'he said "it is - all in all - so" and we go on'
    curly = "he\u00a0said \u201cit is \u2014 all in all \u2014 so\u201d and we go on"
    assert len({r.n for r in table(spark, [(1, plain), (2, curly)]).select(lines.normalise(F.col("text")).alias("n")).collect()}) == 1
    marks = [r.n for r in table(spark, [(1, "\u0915\u0940"), (2, "\u0915\u093e")]).select(lines.normalise(F.col("text")).alias("n")).collect()]
    assert marks == ["\u0915\u0940", "\u0915\u093e"]
    short = "an ox is in a bog up to its jaw so we go"
    wide = "".join(chr(0x4E00 + 37 * i) for i in range(30))
    rows = [(1, short), (2, short.replace("bog", "bag")), (3, wide), (4, wide[:11] + "\u4e01" + wide[12:]), (5, "".join(chr(0x5000 + 41 * i) for i in range(30)))]
    assert {r.doc_id for r in lines.dedup_lines(table(spark, rows)).filter("n_removed > 0").collect()} == {2, 4}


def test_edit_similarity_of_long_lines(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    words = [word(20 if i % 7 == 0 else 4) for i in range(400)]
    longest = [word(20) if len(w) == 20 else w for w in words]
    typos = [w[:-1] + "_" if i % 3 == 0 else w for i, w in enumerate(words)]
    pairs = spark.createDataFrame([(1, 2, " ".join(words), " ".join(longest)), (1, 3, " ".join(words), " ".join(typos))], "a_id long, b_id long, a_text string, b_text string")
    want = {r.b_id for r in pairs.filter("levenshtein(a_text, b_text) <= floor(0.2D * greatest(length(a_text), length(b_text)))").collect()}
    assert want == {3} == {r.b_id for r in lines.edit_similar(pairs, 0.8).collect()}


def test_line_simhash(spark):
    texts = ["one three seven", "x", " ".join(f"w{i:04}" for i in range(700)), "same " * 300 + "other", "a bc def"]
    df = spark.createDataFrame([(i, len(t), t) for i, t in enumerate(texts)], "id long, chars int, normal string")
    rows = {r.mark: r for r in lines.fingerprints(df).collect()}
    for i, t in enumerate(texts):
        hs = [xxhash.xxh64_intdigest(w.encode(), 42) for w in t.split(" ") if len(w.encode()) >= lines.LONG_WORD]
        assert (rows[i].fp & (2**64 - 1) if i in rows else None) == (sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else None)
    assert all(len(set(r["keys"])) == lines.BANDS[0] for r in lines.char_fingerprints(df).collect())


def grouped(spark, texts, **options):
    """Group of each different normalised line, as found among all of them."""
    rows = spark.createDataFrame([(i, len(t), t, i) for i, t in enumerate(texts)], "line long, chars int, normal string, h1 long").withColumn("h2", F.col("h1"))
    found = lines.similar_lines(rows, rows.selectExpr("h1", "h2", "line as id", "1L as n", "chars"), lines.DISTANCE, lines.SIMILARITY, **options)
    of = {r.node: r.component for r in found.collect()}
    return {t: of.get(i, -1 - i) for i, t in enumerate(texts)}


def test_fuzzy_lines_recall_over_all_pairs(spark, sf):
    """Registered settings on all lines of the table against edit similarity over all pairs; the exact setting finds all."""
    texts = documents(spark, sf).select(F.explode(F.split("text", "\n")).alias("line")).select(lines.normalise(F.col("line")).alias("t"))
    texts = texts.filter(F.length("t") >= lines.MIN_CHARS).distinct().select(F.xxhash64("t").alias("id"), "t", F.length("t").alias("n"))
    df = spark.createDataFrame(texts.collect(), texts.schema).repartition(8).cache()
    pairs = df.alias("a").join(df.alias("b"), F.expr("a.n <= b.n and a.id <> b.id and b.n - a.n <= floor(0.2D * b.n) and levenshtein(a.t, b.t, cast(floor(0.2D * b.n) as int)) >= 0"))
    want = {tuple(sorted(r)) for r in pairs.selectExpr("a.t as x", "b.t as y").collect()}
    every = sorted(r.t for r in df.collect())
    of = grouped(spark, every)
    found = sum(of[x] == of[y] for x, y in want)
    assert len(every) > 1000 and len(want) > 30 and found >= 0.95 * len(want)
    # Nothing else is linked: groups are those of the true pairs.
    parent = {t: t for t in every}

    def top(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for x, y in want:
        parent[top(x)] = top(y)
    assert all(len({top(t) for t in own}) == 1 for own in ([t for t in every if of[t] == g] for g in {of[x] for p in want for x in p}))
    few = sorted({x for p in want for x in p})[:120] + every[:150]
    of = grouped(spark, sorted(set(few)), exact=True)
    assert all(of[x] == of[y] for x, y in want if x in of and y in of)


@pytest.mark.parametrize("step", [2, 3, 4, 6])
def test_fuzzy_lines_with_scattered_typos(spark, step):
    """Lines of 25 words with one letter changed in every second to sixth word."""
    rng = random.Random(step)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    pairs = []
    for _ in range(100):
        words = [word() for _ in range(25)]
        typos = [w[:k] + ("q" if w[k] != "q" else "x") + w[k + 1 :] if i % step == 0 else w for i, w in enumerate(words) for k in [rng.randrange(len(w))]]
        pairs.append((" ".join(words), " ".join(typos)))
    texts = [t for p in pairs for t in p]
    of = grouped(spark, texts)
    assert sum(of[a] == of[b] for a, b in pairs) >= 90
    assert all(of[a] != of[c] for (a, _), (c, _) in zip(pairs, pairs[1:]))
    if step == 2:
        of = grouped(spark, texts[:60], exact=True)
        assert all(of[a] == of[b] for a, b in pairs[:30])


def test_fuzzy_lines_of_a_hot_key(spark):
    """Many lines with a long common part: only those that are alike are linked, however many share a key."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    common = " ".join(word() for _ in range(12))
    owns = [" ".join(word() for _ in range(8)) for _ in range(150)]
    texts = [f"{common} {own}" for own in owns] + [f"{common} {own[:-1]}_" for own in owns]
    of = grouped(spark, texts)
    assert sum(of[a] == of[b] for a, b in zip(texts[:150], texts[150:])) >= 140
    assert len({of[t] for t in texts[:150]}) == 150


def test_fuzzy_lines_of_hot_keys_lose_no_pair(spark, monkeypatch):
    """Keys that many lines share give the links that comparing all pairs of every key gives."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9)))
    common, texts = " ".join(word() for _ in range(4)), []
    for _ in range(250):
        words = [word() for _ in range(12)]
        texts += [f"{common} {' '.join(words)}", f"{common} {' '.join(w[:2] + '0' + w[3:] for w in words)}"]
    monkeypatch.setattr(lines, "HOT_KEY", 1 << 30)
    want = grouped(spark, texts)
    monkeypatch.setattr(lines, "HOT_KEY", 3)
    monkeypatch.setattr(lines, "SQUARE", 16, raising=False)
    got = grouped(spark, texts)
    assert got == want and len({g for g in want.values()}) < 400


def test_squares_take_turns_and_meet_every_pair(spark, monkeypatch):
    """Few lines travel at once, and only lines of like lengths meet; each pair of a key that is near is found, once."""
    rng = random.Random(8)
    bits = lambda n: rng.getrandbits(n) - (1 << (n - 1))
    prints = [(i, rng.randint(20, 90), rng.choice([5, 5 << 30, -7]), tuple(bits(64) for _ in range(8))) for i in range(300)]
    marks = spark.createDataFrame(prints, "mark long, chars int, fp long, sketch " + "struct<" + ", ".join(f"w{i}: long" for i in range(8)) + ">")
    keyed = [(k, i, i % 40) for i in range(300) for k in ((1, 2) if i % 3 else (1,))]
    rows = spark.createDataFrame(keyed, "key long, mark long, group long").join(marks.select("mark", "chars"), "mark").withColumn("level", lines._level(0.8)).drop("chars")
    near = lambda a, b: abs(a[1] - b[1]) <= math.floor(max(a[1], b[1]) * 0.2) and bin((a[2] ^ b[2]) & (2**64 - 1)).count("1") <= 3
    one = {(i, j) for i in range(300) for j in range(i) if i % 40 != j % 40 and near(prints[i], prints[j])}
    monkeypatch.setattr(lines, "SQUARE", 16)
    keep, written = lines.materialize, []
    monkeypatch.setattr(lines, "materialize", lambda df, label: (written.append(label), keep(df, label))[1])
    for at_once in (1 << 20, 500):
        written.clear()
        got = [(max(r), min(r)) for df in lines._squares(rows, marks, at_once, 3, 0.8) for r in df.collect()]
        assert set(got) == one and len(got) == len(one) + sum(1 for i, j in one if i % 3 and j % 3)
        assert (written.count("line-near") > 4) == (at_once == 500)


def test_texts_of_lines_without_a_pair_stay(spark, monkeypatch):
    """The sieve comes before the exchange of the texts that are compared."""
    seen, keep = {}, lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, label: (seen.update({label: df._jdf.queryExecution().optimizedPlan().toString()}), keep(df, label))[1])
    texts = [f"one line of some words number {'abcdefghij'[i % 10] * 9} {i // 10}" for i in range(20)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line long, normal string")
    links = lines.verified(rows, spark.createDataFrame([(0, 10), (3, 4)], "a_id long, b_id long"), 0.9).collect()
    assert [tuple(r) for r in links] == [(0, 10)]
    last = next(x for x in seen["line-texts"].split("\n") if "Join" in x)
    assert re.search(r"\(id#\d+L = id#\d+L\)", last)


def test_fuzzy_lines_keep_one_of_equal_rows(spark):
    line, other = "a line that three rows without an id have", "one more line of the same three documents"
    rows = [(None, f"{line}\n{other}")] * 3 + [(7, line), (8, "x\n" + other.replace("more", "mere")), (9, "y"), (9, "y")]
    out = lines.dedup_lines(table(spark, rows)).collect()
    assert sorted(r.text for r in out if r.doc_id is None) == ["", "", f"{line}\n{other}"]
    assert sorted((r.text, r.n_removed) for r in out if r.doc_id) == [("", 1), ("x", 1), ("y", 0), ("y", 0)]


def test_fuzzy_lines_all_lengths_and_words(spark):
    """min_chars 0 takes in short lines, which words of any length tell apart."""
    rows = [(1, "ab cd\nx"), (2, "ab cd\n\nx"), (3, "ab ce fg hi"), (4, "ab ce fg hx")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(table(spark, rows), min_chars=0).collect()}
    assert got == {1: "ab cd\nx", 2: "", 3: "ab ce fg hi", 4: ""}


def test_sketches_agree(spark):
    rows = [tuple(random.Random(i).getrandbits(63) for _ in range(lines.HASHES)) for i in range(2)]
    rows[1] = tuple(a if i % 3 == 0 else b for i, (a, b) in enumerate(zip(*rows)))
    df = spark.createDataFrame(rows, ", ".join(f"m{i} long" for i in range(lines.HASHES))).select(lines._sketch())
    got = {r.n for r in df.select(F.col("sketch").alias("a")).join(df.select(F.col("sketch").alias("b"))).select(lines._agreeing("a", "b").alias("n")).collect()}
    assert got == {lines.HASHES, sum((x ^ y) & 255 == 0 for x, y in zip(*rows))}


def test_sketches_are_read_twice_at_most(spark):
    """Pairs of a hot key are many: a join reads its rows again for each mention of a column."""
    words = ", ".join(f"w{i}: bigint" for i in range(lines.HASHES // 8))
    df = spark.createDataFrame([], f"a struct<{words}>, b struct<{words}>").select(lines._agreeing("a", "b").alias("n"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert all(1 <= len(re.findall(rf"\ba#\d+\.w{i}\b", plan)) <= 2 for i in range(lines.HASHES // 8))


def test_bounds_of_edits(spark, monkeypatch):
    """What pieces and the lines without frequent characters tell holds for the edits of the whole; each settles some pairs."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("etaoinshrdlucmfw\u00e9\u4e01", k=rng.randint(2, 9)))
    rows = []
    for i in range(300):
        a = [word() for _ in range(rng.choice((1, 4, 20, 50)))]
        b = [word() if rng.random() < (0, 0.05, 0.15, 0.3, 0.7, 1)[i % 6] else w[: rng.randint(1, 9)] if rng.random() < 0.1 else w for w in a]
        rows.append((2 * i, 2 * i + 1, " ".join(a), " ".join(b[i % 3 :] + b[: i % 2])))
    pairs = spark.createDataFrame(rows, "a_id long, b_id long, a_text string, b_text string").withColumn("most", F.expr("cast(floor(0.2D * greatest(length(a_text), length(b_text))) as int)"))
    pairs = pairs.withColumn("edits", F.expr("levenshtein(a_text, b_text)")).cache()
    for cut in ((8, 1, 1024), *lines.PIECES):
        near = pairs.withColumn("pieces", F.expr(lines._pieces(*cut))).filter(f"{lines._piecewise()} <= most")
        assert near.count() > 20 and near.filter("edits > most").isEmpty()
    far = pairs.filter(lines._surely_far())
    assert far.count() > 20 and far.filter("edits <= most").isEmpty()
    want = {r.a_id for r in pairs.filter("edits <= most").collect()}
    for long in (0, 5, lines.LONG_EDITS):
        monkeypatch.setattr(lines, "LONG_EDITS", long)
        assert {r.a_id for r in lines.edit_similar(pairs.select("a_id", "b_id", "a_text", "b_text"), 0.8).collect()} == want


def test_sieve(spark):
    rows = spark.range(5000).withColumn("x", F.col("id") * 7919)
    wanted = rows.filter("id % 10 = 3")
    out = sieve(rows, wanted, "x").collect()
    assert all(r._maybe for r in out if r.id % 10 == 3) and sum(r._maybe for r in out) < 520 and len(out) == 5000
    assert not any(r._maybe for r in sieve(rows, wanted.limit(0), "x").collect())


def test_block_scheme():
    for n in (10, 1 << 30, 1 << 40):
        blocks, agree = lines.scheme(n)
        assert blocks - agree == lines.DISTANCE


# 1 again: clashing columns


def test_parsed_columns_replace_clashing_ones(odd):
    media = mpegts.to_media(odd).withColumn("pes", F.lit("mine")).withColumn("packets", F.lit(-1))
    assert all(r.pes >= 1 and r.packets > 0 for r in mpegts.parse_media(media).collect())


# 5: SimHash


def plain_fingerprint(text, words=3):
    found = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, values, near):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in zip(ids, values):
        for j, b in zip(ids, values):
            if i < j and near(a, b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_simhash_documents(spark, sf, odd, empty):
    docs = documents(spark, sf)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    want = plain_components([d for d, _ in rows], [f for _, f in rows], lambda a, b: (a ^ b).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{f:016x}", want[d]) for d, f in rows}
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and {r.component_id for r in out if r.doc_id in (1, 2)} == {1}
    assert [r.component_id for r in out if r.doc_id is None] == [None] and [r.component_id for r in out if r.doc_id == 4] == [4, 4]
    assert simhash.near_duplicates(empty).collect() == []


def test_simhash_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 999}" for i in range(5000)).encode()
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK_WORDS", 7)
    assert simhash.fingerprint(text) == want == plain_fingerprint(text.decode())


def test_pigeonring_finds_all_groups(spark):
    rng = random.Random(11)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    rows = [(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in enumerate(fps)]
    found = connected_components(simhash.near_links(spark.createDataFrame(rows, "fp long, rep long")))
    got = {r.node: r.component for r in found.collect()}
    want = plain_components(range(len(fps)), fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {i: got.get(i, i) for i in want} == want


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = {(a, b) for a, b in links if a is not None} | {(b, a) for a, b in links if a is not None}
    ids = sorted({x for p in pairs for x in p})
    want = plain_components(ids, ids, lambda a, b: (a, b) in pairs)
    assert {i: got.get(i, i) for i in ids} == want


# 6: byte pairs


def test_bytes_pairs(spark, sf, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [r.text for r in documents(spark, sf).collect()] + [t for _, t in ODD] + ["a" * 999, "a" * 2500 + " b", "".join(random.Random(3).choices("theanigr", k=4000)) + " tail", "z " + "日本語" * 700, "aaaaa hahahahaha 's's ' t", "\x1c\x85\xa0 x\u2003y"]
    docs = table(spark, list(enumerate(texts)))
    for r in bpe.encode(docs, path).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").collect():
        want = plain.encode(r.t or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(empty, path).collect() == [] and bpe.encode(odd, path).count() == len(ODD)


# 7: embeddings


def test_embeddings(spark, sf):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + (0.05 if i % 3 else 0.4) * rng.normal(size=16)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(70)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0, 2.0]), (None, rows[5][1]), (2005, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, n_links string")
    good = [(i, np.array(v)) for i, v in rows if i is not None and i < 2000]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.95
    at = {i: k for k, (i, _) in enumerate(good)}
    want = plain_components(list(at), list(at), lambda a, b: near[at[a], at[b]])
    got = hnsw.near_embeddings(df, shards=3).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    links = sum(int(near[k].sum()) - 1 for k in range(len(good)))
    assert sum(by[i].n_links for i in at) >= 0.99 * links
    assert np.mean([by[i].component_id == want[i] for i in at]) > 0.99
    assert all(by[i].n_links == 0 and by[i].kept for i in range(2000, 2006)) and by[None].n_links == 0 and by[None].kept is False
    assert hnsw.near_embeddings(df.limit(0)).collect() == []


def pack(unit, rep):
    import pyarrow as pa

    rep = np.array(rep)
    ids = pa.array(rep)
    n = len(rep)
    shard = pa.table({"d": pa.array([16] * n, pa.int32()), "parts": [1] * n, "shard": [0] * n, "rep": ids, "h1": ids, "m": [1] * len(rep), "v": pa.array(unit.tolist())})
    return hnsw._build(shard), shard


def test_embedding_audit(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(100, 16))
    graphs, rows = pack(np.concatenate([base, base[:10] + 0.01]), range(110))
    within = hnsw.Graph.within
    monkeypatch.setattr(hnsw.Graph, "within", lambda self, q, least, beam: ([np.array([row.argmax()]) for row in q @ self.vectors.T], np.zeros(len(q), bool)))
    audit = hnsw._audit(0.95, graphs, rows).to_pydict()
    assert sum(audit["exact"]) == 20 * len(hnsw.BEAMS) and sum(audit["found"]) < sum(audit["exact"])
    monkeypatch.setattr(hnsw.Graph, "within", within)
    audit = hnsw._audit(0.95, graphs, rows).to_pydict()
    assert audit["found"] == audit["exact"]
    recall = lambda *rows: [{"beam": b, "pooled": p, "mean": m, "n": n} for b, p, m, n in rows]
    assert hnsw.passing(recall((64, 1.0, 0.9, 99), (128, 0.9, 1.0, 99)), 0.99) == 0
    assert hnsw.passing(recall((64, 1.0, 1.0, 99), (128, 1.0, 1.0, 99)), 0.99) == 64
    # No beam without a verdict.
    assert hnsw.passing(recall((64, 1.0, 1.0, 3)), 0.99) == hnsw.passing([], 0.99) == 0


@pytest.mark.parametrize("beam, full", [(64, 256), (64, 3), (0, 256)])
def test_embedding_cells(monkeypatch, beam, full):
    """Links of one shard and of two by graph, by graph with hot vectors, and by brute force alone."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(90, 16))
    near = lambda k, n: base[k] + 0.05 * rng.normal(size=(n, 16))
    left, right = np.concatenate([base[:60], near(3, 9), near(4, 2)]), np.concatenate([base[60:], near(3, 8), near(5, 1), near(70, 3)])
    monkeypatch.setattr(hnsw, "FULL", full)
    graphs = [pack(v, at + np.arange(len(v)))[0] for v, at in ((left, 0), (right, 1000))]
    import pyarrow as pa

    for some in ([graphs[0]], graphs):
        sides = [(left, 0), (right, 1000)][: len(some)]
        ids = np.concatenate([at + np.arange(len(v)) for v, at in sides])
        unit = np.concatenate([v for v, _ in sides])
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        near_ = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
        if len(some) == 2:
            near_ &= (ids[:, None] < 1000) != (ids[None] < 1000)
        out = hnsw._links(0.95, beam, pa.concat_tables(some)).to_pylist()
        assert {r["rep"]: r["links"] for r in out if r["links"]} == {int(i): int(n) for i, n in zip(ids, near_.sum(1)) if n}
        ties = [(r["a"], r["b"]) for r in out if r["a"] is not None]
        want = plain_components(ids.tolist(), ids.tolist(), lambda x, y: near_[np.searchsorted(ids, x), np.searchsorted(ids, y)])
        assert plain_components(ids.tolist(), ids.tolist(), lambda x, y: (x, y) in ties or (y, x) in ties) == want


def test_embeddings_with_few_links_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, (base[i] + 0.01 * rng.normal(size=16)).tolist()) for i in range(0, 400, 10)]
    rows += [(1, base[350].tolist()), (2000, base[7].tolist()), (2000, base[9].tolist())]
    got = hnsw.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=2).collect()
    by = {r.vec_id: r for r in got}
    assert all(by[1000 + i].component_id == (i if i != 350 else 1) and by[1000 + i].n_links >= 1 for i in range(0, 400, 10))
    assert by[2000].component_id == by[9].component_id == 7 and by[350].component_id == 1 and by[1].kept
    assert sum(r.n_links for r in got) == 2 * 40 + 2 + 2 + 2 * 2


def test_embedding_beams_by_length_and_scale(spark, monkeypatch):
    """Each length has its own audit; rounds go on until it finds links; vectors of any scale are compared."""
    rng = np.random.default_rng(12)
    many, few = rng.normal(size=(300, 8)), rng.normal(size=(300, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(np.r_[many, many + 0.001])] + [(1000 + i, v.tolist()) for i, v in enumerate(few)]
    rows += [(3000, [1e-170, 2e-170]), (3001, [1e170, 2e170]), (3002, [5e-324, 1e-323]), (3003, [0.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    real = hnsw.audited_beams
    monkeypatch.setattr(hnsw, "audited_beams", lambda *a: seen.append(real(*a)) or seen[-1])
    monkeypatch.setattr(hnsw, "AUDIT_QUERIES", (10, 200))
    got = {r.vec_id: r for r in hnsw.near_embeddings(df, shards=2).collect()}
    assert seen[0][8] > 0 and seen[0][2] == 0
    assert all(got[i].component_id == got[i + 300].component_id and got[i].n_links >= 1 for i in range(300))
    unit = few / np.linalg.norm(few, axis=1, keepdims=True)
    assert [got[1000 + i].n_links for i in range(300)] == ((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()
    assert [got[i].n_links for i in (3000, 3001, 3002, 3003)] == [2, 2, 2, 0]


# 8: languages


def test_languages(spark, empty):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = langid.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert langid.language_predictions(empty).collect() == []


def test_languages_with_a_text_repeated_often(spark):
    """A language keeps its other rows however often one of them is repeated."""
    word = lambda i: f"mot{i} élan forêt déjà rêve" if i < 100 else f"word{i} the thing with that"
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids[0], "déjà vu élève", "fr")] * 5000 + [(i, word(k), "fr") for k, i in enumerate(ids[1:31])] + [(i, word(100 + k), "en") for k, i in enumerate(ids[40:540])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs, per_lang=100)[0] == ["en", "fr"]
    with pytest.raises(ValueError, match="languages"):
        many = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(700)], docs.schema)
        langid.train(many)


def test_language_memory():
    """Texts are predicted in batches that leave room for an executor's other work."""
    texts = pa.array(["the people of the town went to the market to buy bread " * 40] * 2000)
    model = (["en", "de"], np.zeros((1 << langid.BITS, 2)), np.zeros(2), 1.0)
    batch = pa.record_batch([texts], names=["text"])
    langid._letters()
    tracemalloc.start()
    rows = sum(b.num_rows for b in langid._predict_rows(types.SimpleNamespace(value=model), [batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and peak < 120 << 20


def test_language_model_equals_a_plain_one():
    """Follow-the-regularised-leader, coordinate by coordinate in dictionaries, then a search for the temperature."""
    rng = random.Random(2)
    make = lambda a: " ".join("".join(rng.choices(a, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 9)))
    langs = [("aa", "bb", "cc")[i % 3] for i in range(60)]
    texts = [make({"aa": "abcd", "bb": "cdef", "cc": "éüxa"}[x]) for x in langs]
    names, weights, bias, temperature = langid.fit(texts, langs)
    counts = [collections.Counter(langid.grams([t])[0].tolist()) for t in texts]
    idf = {b: np.log((1 + len(texts)) / (1 + sum(b in c for c in counts))) + 1 for c in counts for b in c}
    rows = [{b: langid.SCALE * n / max(sum(c.values()), 1) * idf[b] for b, n in c.items()} for c in counts]
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    w = lambda k: 0.0 if abs(z[k]) <= langid.L1 else -(z[k] - np.sign(z[k]) * langid.L1) / ((langid.BETA + n[k] ** 0.5) / langid.ALPHA + langid.L2)
    score = lambda row: np.array([sum(x * w((b, k)) for b, x in row.items()) + w(("bias", k)) for k in range(3)])
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    held = [i for i in range(60) if i % 5 == 4]
    order = np.random.default_rng(0)
    for _ in range(langid.EPOCHS):
        for i in order.permutation([i for i in range(60) if i % 5 != 4]):
            miss = soft(score(rows[i])) - (np.arange(3) == names.index(langs[i]))
            for b, x in [*rows[i].items(), ("bias", 1.0)]:
                for k in range(3):
                    g, old = x * miss[k], w((b, k))
                    z[b, k] += g - ((n[b, k] + g * g) ** 0.5 - n[b, k] ** 0.5) / langid.ALPHA * old
                    n[b, k] += g * g
    loss = lambda t: -sum(np.log(soft(score(rows[i]) / t)[names.index(langs[i])] + 1e-12) for i in held)
    assert names == ["aa", "bb", "cc"] and temperature == pytest.approx(min(np.geomspace(0.25, 20, 200), key=loss))
    assert bias == pytest.approx([w(("bias", k)) for k in range(3)])
    got = langid.predict((names, weights, bias, temperature), texts)
    for t, row, lang, p in zip(texts, rows, *got):
        want = soft(score(row) / temperature)
        assert (lang, p) == ((names[int(want.argmax())], pytest.approx(want.max(), rel=1e-6)) if row else ("und", 0.0))


def test_languages_odd_rows(spark, odd):
    got = {r.doc_id: r for r in langid.language_predictions(odd).collect()}
    assert (got[1].lang_pred, got[1].score, got[2].lang_pred) == ("und", 0.0, "und") and got[None].held_out is False
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_predictions(unlabelled).collect()} == {"und"}
    assert langid.identify(odd).columns[-2:] == ["lang_pred", "score"]


# 9: URLs


def test_urls(spark):
    rows = [
        ("https://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.com/fr/#porn", "x.com", "/fr/", "com/fr/", "allow"),
        ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("http://com.net?a://b", "com.net", "", None, "allow"),
        ("http://www.xxx.net/a", "www.xxx.net", "/a", None, "block"),
        ("http://xxxl.net/sextant", "xxxl.net", "/sextant", None, "allow"),
        ("http://free-casino.net/", "free-casino.net", "/", None, "allow"),
        ("http://free-casino.net/Bonus?free", "free-casino.net", "/Bonus", None, "block"),
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("nothing", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], "<p>", "h") for i, r in enumerate(rows)], "page_id long, url string, html string, host string")
    got = urls.judge(df).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [r[1:] for r in rows]
    assert urls.judge(df.limit(0)).collect() == []
    own = spark.createDataFrame([("Nothing", 6), ("ÉTÉ", 3), ("nothing", 1), ("free", 6), (None, 6), ("", 6), ("bonus", None)], "term string, weight int")
    assert urls.read_vocabulary(own) == {"nothing": 6, "free": 6, "ÉtÉ": 3}
    assert [r.verdict for r in urls.judge(df, vocabulary=own).orderBy("page_id").collect()][6:] == ["allow", "allow", "block", "block", "allow", "allow", "block"]


# 10: mixing


def test_mixing(spark, sf, odd, empty):
    docs = documents(spark, sf).select("doc_id", "text", "source", F.lit(1).alias("size"))
    docs = docs.unionByName(spark.createDataFrame([(None, "a b", None, 1), (-1, None, "zero", 1), (-2, "x " * 20_000, "src3", 1)], docs.schema))
    got = mixing.mix(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert len(got) == docs.count()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    share, fixed = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        share = {s: 3 * sizes[s] if s in fixed else rest * weight[s] / sum(weight[x] for x in sizes if x not in fixed) for s in sizes}
        over = {s for s in sizes if s not in fixed and share[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    for s in sizes:
        assert target[s] == pytest.approx(share[s]) and abs(taken[s] - target[s]) <= max(r.size for r in got if r.source == s)
    again = mixing.mix(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(empty).collect() == [] and mixing.mix(odd).count() == len(ODD)


def test_mixing_caps_copies_and_cuts_repeated_keys(spark):
    """Documents without a word are held three times at most; one document repeated often is spread over many ranges."""
    rows = [(1, "", "small"), (2, "one two", "small"), (3, None, "small")] + [(100 + i, "w " * (1 + i % 9), "large") for i in range(500)] + [(7, "same text again", "large")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert max(r.copies for r in out) == 3 and {(r.doc_id, r.copies) for r in out if r.source == "small"} == {(1, 3), (2, 3), (3, 3)}
    large = [r for r in out if r.source == "large"]
    assert len(large) == 3500 and abs(sum(r.taken for r in large) - large[0].target) <= 9
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(docs.repartition(6)).collect()))


def test_every_operator_is_registered():
    assert [int(n.split("_")[0][2:]) for n in queries.QUERIES] == list(range(1, 14))
