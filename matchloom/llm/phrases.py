"""Phrase collocation mining by multikey quicksort of suffix pointers.

Words, and hashes of pairs of words, are counted first, as a phrase holds no rarer ones. A text's pieces
then are suffixes of up to four words that end before a rare pair. Tasks over the texts add up equal
suffixes of what they hold and route them by language and leading words to shards of bounded size. A shard
sorts pointers to its suffixes by three-way partitions, one word at a time: the pointers equal to a pivot are
all the places of one phrase, so their number is its count, and they alone go on to the next word. Partitions
smaller than the least count are abandoned. Counts of phrases are joined and scored with DataFrame functions.
"""

from __future__ import annotations

import struct
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, release, utf8

LEAST, LONGEST = 30, 4
#: A longer phrase with this share (in hundredths) of a phrase's places stands for it.
COVERED = 80
REPORT = 2000
UNKNOWN = "und"
SCALE = 2_000_000
#: Bytes of text whose words and pairs make one shard of the first counts; suffixes of one shard of the second, and from which
#: it is split further.
SHARD_BYTES, SHARD_ROWS, SPLIT_ROWS = 8 << 20, 1 << 20, 4 << 20
#: Words that a task holds before it adds up what it has and sends it off.
HELD_WORDS = 3 << 19
SLICE = 1 << 20
#: Bits of a pair's hash, and of the map of frequent pairs that tasks look at: 16 MB whatever the number of pairs. Pairs that
#: share either only save less; what they let through is counted exactly.
PAIR_BITS, SIEVE_BITS = 40, 27
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
EMPTY, BREAK, FIRST = 0, 1, 2


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


class _Held:
    """The words of one language that a task has read and not yet sent: numbers in order, breaks between pieces."""

    def __init__(self, carried: list[bytes] = ()):
        self.words = _Vocabulary({b"": EMPTY, b"\n": BREAK})
        self.parts = [np.array([self.words[w] for w in carried], np.int32)]
        self.size = len(carried)

    def add(self, text: bytes) -> None:
        text = text.translate(_PLAIN)
        at = 0
        while at < len(text):
            end = text.find(b" ", at + SLICE)
            end = len(text) if end < 0 else end
            found = text[at:end].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.words.__getitem__, found), np.int32, len(found))
            self.parts.append(ids[ids != EMPTY])
            self.size += len(self.parts[-1])
            at = end
        self.parts.append(np.array([BREAK], np.int32))

    def hashes(self, lang: str) -> np.ndarray:
        """A hash of each word of the language."""
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        return np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)

    def counts(self, lang: str):
        """(words, how often each was read, their hashes, hashes of pairs, how often each was read); a part is whole texts."""
        ids, of = np.concatenate(self.parts), self.hashes(lang)
        n = np.bincount(ids, minlength=len(self.words))
        both = np.flatnonzero((ids[:-1] >= FIRST) & (ids[1:] >= FIRST))
        pairs, times = np.unique(pair_hash(of[ids[both]], of[ids[both + 1]]), return_counts=True)
        return list(self.words)[FIRST:], n[FIRST:], of[FIRST:], pairs, times

    def suffixes(self, lang: str, frequent, last: bool):
        """(words, rows of LONGEST places, counts, carried words): equal suffixes once, each as far as its pairs are frequent. The
        last places wait for what follows them."""
        ids, of = np.concatenate(self.parts), self.hashes(lang)
        self.parts = []
        texts = list(self.words)
        ready = len(ids) if last else max(0, len(ids) - LONGEST + 1)
        carried = [texts[i] for i in ids[ready:]]
        ids = np.concatenate([ids, np.full(LONGEST, BREAK, np.int32)])
        goes_on = (ids[:-1] >= FIRST) & (ids[1:] >= FIRST)
        at = np.flatnonzero(goes_on)
        goes_on[at] = frequent(pair_hash(of[ids[at]], of[ids[at + 1]]))
        # Frequent words get small numbers, which pack well.
        n = np.bincount(ids, minlength=len(texts))
        order = np.argsort(-n, kind="stable")
        number = np.empty(len(texts), np.uint64)
        number[order] = np.arange(1, len(order) + 1, dtype=np.uint64)
        starts = np.flatnonzero(goes_on[:ready])
        third = goes_on[starts + 1]
        fourth = third & goes_on[starts + 2]
        high = number[ids[starts]] << np.uint64(32) | number[ids[starts + 1]]
        low = (number[ids[starts + 2]] * third) << np.uint64(32) | number[ids[np.minimum(starts + 3, len(ids) - 1)]] * fourth
        by = np.lexsort((low, high))
        high, low = high[by], low[by]
        new = np.ones(len(by), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(by)))
        rows = np.empty((len(first), LONGEST), np.int32)
        for k, wide in enumerate((high[first], low[first])):
            rows[:, 2 * k] = (wide >> np.uint64(32)).astype(np.int32) - 1
            rows[:, 2 * k + 1] = (wide & np.uint64(0xFFFFFFFF)).astype(np.int32) - 1
        return [texts[i] for i in order], rows, times.astype(np.int64), carried


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b >> np.uint64(1))
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - PAIR_BITS)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of one weight together."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def _unplaned(data: memoryview, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(kind).ravel()


def pack(words: list[bytes], rows: np.ndarray, times: np.ndarray) -> bytes:
    """Suffixes with the words that they hold, as bytes."""
    used = np.zeros(len(words) + 1, bool)
    used[rows.ravel()] = True
    used[-1] = False
    number = np.cumsum(used) * used
    held = [words[i] for i in np.flatnonzero(used)]
    planes = _planes(number[rows].T.astype("<u4").ravel())
    sizes = np.array([len(w) for w in held], "<u4").tobytes()
    return zstandard.compress(struct.pack("<II", len(rows), len(held)) + sizes + planes + times.astype("<i8").tobytes() + b"".join(held), 1)


def unpack(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    data = zstandard.decompress(blob)
    n, k = struct.unpack_from("<II", data)
    sizes = np.frombuffer(data, "<u4", k, 8)
    at = 8 + 4 * k
    rows = _unplaned(memoryview(data)[at:], LONGEST * n, "<u4").reshape(LONGEST, n).T.astype(np.int32) - 1
    at += 4 * LONGEST * n
    times = np.frombuffer(data, "<i8", n, at)
    ends = at + 8 * n + np.cumsum(sizes, dtype=np.int64)
    return [data[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())], rows, times


def _hashes(words: list[bytes], rows: np.ndarray, lang: str, depth: int) -> np.ndarray:
    """A hash of language and the first ``depth`` words of each row."""
    of = np.array([xxhash.xxh64_intdigest(w) for w in words] + [0], np.uint64)
    h = np.full(len(rows), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for k in range(depth):
        h = (h ^ of[rows[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _dealt(words, rows, times, to: np.ndarray):
    """The rows of each value of ``to``, packed."""
    by = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[by], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(by))):
        own = by[a:b]
        yield int(to[own[0]]), len(own), pack(words, rows[own], times[own])


_ROUTES = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("lang", pa.string()), ("size", pa.int64()), ("blob", pa.binary())])


def _read(batches, full):
    """Read texts of (text, lang) into what is held by language; yield that whenever ``full`` words are held, and last, with
    whether that was all. The receiver empties it."""
    held: dict[str, _Held] = {}
    for batch in batches:
        offsets, data = utf8(batch.column(0))
        for lang, a, b in zip(batch.column(1).to_pylist(), offsets[:-1], offsets[1:]):
            if a < b:
                held.setdefault(lang, _Held()).add(bytes(data[a:b]))
                if sum(h.size for h in held.values()) >= full:
                    yield held, False
    yield held, True


_TALLIES = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("total", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary())])


def _tally(shards: int, batches):
    """Words and hashes of pairs of each part of the texts with their counts, packed by shard; each goes to one shard.

    Parts end between texts, so that no pair is cut.
    """
    for held, _ in _read(batches, HELD_WORDS):
        for lang in list(held):
            words, n, of, pairs, times = held.pop(lang).counts(lang)
            word_to, pair_to = (of % np.uint64(shards)).astype(np.int64), (pairs % np.uint64(shards)).astype(np.int64)
            by_word, by_pair = np.argsort(word_to, kind="stable"), np.argsort(pair_to, kind="stable")
            word_ends, pair_ends = (np.searchsorted(to[by], np.arange(shards + 1)) for to, by in ((word_to, by_word), (pair_to, by_pair)))
            for k in np.union1d(word_to, pair_to).tolist():
                own, two = by_word[word_ends[k] : word_ends[k + 1]], by_pair[pair_ends[k] : pair_ends[k + 1]]
                texts = [words[i] for i in own]
                packed = struct.pack("<I", len(own)) + _planes(n[own].astype("<i8")) + np.array([len(w) for w in texts], "<u4").tobytes() + b"".join(texts)
                # The hashes of a part are in order: differences are small.
                apart = struct.pack("<I", len(two)) + _planes(np.diff(pairs[two], prepend=np.uint64(0)).astype("<u8")) + _planes(times[two].astype("<i8"))
                yield pa.record_batch([pa.array([k]), pa.array([lang]), pa.array([int(n[own].sum())]), pa.array([zstandard.compress(packed, 1)], pa.binary()), pa.array([zstandard.compress(apart, 1)], pa.binary())], schema=_TALLIES)


_SUMS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("pair", pa.int64()), ("n", pa.int64())])


def _sum(least: int, key, table: pa.Table) -> pa.Table:
    """The frequent words and pairs of a shard and a language, and a row with neither: the number of all its words."""
    words: dict[bytes, int] = {}
    pairs, times = [], []
    for blob, other in zip(table["words"], table["pairs"]):
        data = memoryview(zstandard.decompress(blob.as_py()))
        (k,) = struct.unpack_from("<I", data)
        n, sizes = _unplaned(data[4:], k, "<i8"), np.frombuffer(data, "<u4", k, 4 + 8 * k)
        at = 4 + 12 * k
        for size, times_ in zip(sizes.tolist(), n.tolist()):
            word = bytes(data[at : at + size])
            words[word] = words.get(word, 0) + times_
            at += size
        data = memoryview(zstandard.decompress(other.as_py()))
        (k,) = struct.unpack_from("<I", data)
        pairs.append(np.cumsum(_unplaned(data[4:], k, "<u8")))
        times.append(_unplaned(data[4 + 8 * k :], k, "<i8"))
    pairs, times = np.concatenate(pairs), np.concatenate(times)
    by = np.argsort(pairs, kind="stable")
    pairs, times = pairs[by], times[by]
    first = np.flatnonzero(np.diff(pairs, prepend=np.uint64(1 << 63)))
    total = np.add.reduceat(times, first) if len(first) else times
    often = total >= least
    kept = [(w, n) for w, n in words.items() if n >= least]
    two = int(often.sum())
    return pa.table([
        pa.array([key[1].as_py()] * (len(kept) + two + 1), pa.string()), pa.array([*(w for w, _ in kept), *[None] * (two + 1)], pa.binary()).cast(pa.string()),
        pa.array([*[None] * len(kept), *pairs[first][often].tolist(), None], pa.int64()), pa.array([*(n for _, n in kept), *total[often].tolist(), sum(table["total"].to_pylist())], pa.int64()),
    ], schema=_SUMS)


def _seen(bits: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether each pair may be frequent."""
    spot = pairs & np.uint64((1 << SIEVE_BITS) - 1)
    return (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _route(shards: int, sieve, batches):
    """Packed suffixes by shard."""
    bits = np.frombuffer(sieve.value, np.uint8)
    for held, last in _read(batches, HELD_WORDS):
        for lang in list(held):
            words, rows, times, carried = held.pop(lang).suffixes(lang, partial(_seen, bits), last)
            if not last:
                held[lang] = _Held(carried)
            for shard, size, blob in _dealt(words, rows, times, (_hashes(words, rows, lang, 2) % np.uint64(shards)).astype(np.int64)):
                yield pa.record_batch([pa.array([shard]), pa.array([0]), pa.array([lang]), pa.array([size]), pa.array([blob], pa.binary())], schema=_ROUTES)


def _split(batches):
    """Deal packed suffixes of too large shards out once more, by all their words."""
    for batch in batches:
        for row in batch.to_pylist():
            words, rows, times = unpack(row["blob"])
            to = 1 + (_hashes(words, rows, "split", LONGEST) % np.uint64(row["parts"])).astype(np.int64)
            found = list(_dealt(words, rows, times, to))
            n = len(found)
            yield pa.record_batch([pa.array([row["shard"]] * n), pa.array([f[0] for f in found]), pa.array([row["lang"]] * n), pa.array([f[1] for f in found]), pa.array([f[2] for f in found], pa.binary())], schema=_ROUTES)


def partitions(rows: np.ndarray, times: np.ndarray, least: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, words, count) of each phrase of the rows' first words that occurs often enough.

    Multikey three-way quicksort, all open partitions of one round at once: each is cut into what is
    smaller than, equal to and greater than its pivot at the partition's word. ``least[d]`` is the
    count that phrases of d + 1 words need; what has fewer is abandoned.
    """
    n, width = rows.shape
    flat, least = np.ascontiguousarray(rows).ravel(), np.array(least, np.int64)
    pointer, size, depth = np.arange(n), np.array([n] if n else [], np.int64), np.zeros(min(n, 1), np.int64)
    found: list[tuple] = []
    while len(size):
        start = np.cumsum(size) - size
        value = flat[pointer * width + np.repeat(depth, size)]
        a, b, c = value[start], value[start + size // 2], value[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        wide = np.repeat(pivot, size)
        parts = []
        for mask, deeper in ((value < wide, 0), (value == wide, 1), (value > wide, 0)):
            many = np.add.reduceat(mask, start, dtype=np.int64)
            some = many > 0
            own, many = pointer[mask], many[some]
            if not len(many):
                continue
            first = np.cumsum(many) - many
            total, level = np.add.reduceat(times[own], first), depth[some] + deeper
            if deeper:
                ok = (pivot[some] >= 0) & (total >= least[level - 1])
                found.append((own[first][ok], level[ok], total[ok]))
                ok &= level < width
            else:
                ok = total >= least[level]
            parts.append((own[np.repeat(ok, many)], many[ok], level[ok]))
        pointer, size, depth = (np.concatenate(x) for x in zip(*parts))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def _count(least: int, key, table: pa.Table) -> pa.Table:
    """Counts of one shard's phrases; those of a split shard are partial, but for the longest."""
    words = _Vocabulary()
    rows, times = [], []
    for blob in table["blob"]:
        own, places, n = unpack(blob.as_py())
        number = np.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)), np.int32(-1))
        rows.append(number[places])
        times.append(n)
    rows, times = np.concatenate(rows), np.concatenate(times)
    texts = list(words)
    whole = key[1].as_py() == 0
    row, depth, total = partitions(rows, times, (least if whole else 1,) * (LONGEST - 1) + (least,))
    # The places of the first word alone are those of its pairs in this shard.
    row, depth, total = (x[depth > 1] for x in (row, depth, total))
    phrases = [b" ".join([texts[i] for i in rows[r, :d]]) for r, d in zip(row, depth.tolist())]
    return pa.table([pa.array([key[2].as_py()] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(depth, pa.int32()), pa.array(total, pa.int64())], schema=_COUNTS)


def counts(docs: DataFrame, least: int = LEAST, shard_rows: int = SHARD_ROWS, split_rows: int = SPLIT_ROWS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of all phrases of 1 to LONGEST words that occur ``least`` times, (lang, total) of all words).

    A shard with more rows than ``split_rows``, as with one very frequent pair of words, is split by all words of its
    suffixes; the parts' counts are added up afterwards.
    """
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    shards = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    tallied = texts.mapInArrow(partial(_tally, shards), "shard long, lang string, total long, words binary, pairs binary")
    often = tallied.groupBy("shard", "lang").applyInArrow(lambda key, table: _sum(least, key, table), "lang string, word string, pair long, n long")
    often = materialize(often, "phrase-words")
    totals = often.filter("word is null and pair is null").groupBy("lang").agg(F.sum("n").alias("total"))
    spot = F.pmod("pair", F.lit(1 << SIEVE_BITS))
    pairs = often.filter("pair is not null")
    held = pairs.select(spot.alias("spot")).groupBy(F.expr("spot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros((1 << SIEVE_BITS) // 64, np.int64)
    bits[held["at"].to_numpy()] = held["bits"].to_numpy()
    sieve = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    shards = max(1, -(-(pairs.agg(F.sum("n")).first()[0] or 0) // shard_rows))
    routes = "shard long, part long, lang string, size long, blob binary"
    dealt = materialize(texts.mapInArrow(partial(_route, shards, sieve), routes), "phrase-routes")
    large = dealt.groupBy("shard").agg(F.sum("size").alias("rows")).filter(F.col("rows") > split_rows)
    large = materialize(large.select("shard", F.ceil(F.col("rows") / (split_rows / 2)).cast("long").alias("parts")), "phrase-large")
    tally = lambda df: df.groupBy("shard", "part", "lang").applyInArrow(lambda key, table: _count(least, key, table), "lang string, phrase string, words int, n long")
    if large.isEmpty():
        found = tally(dealt)
    else:
        again = dealt.join(large, "shard").select("shard", "parts", "lang", "blob").mapInArrow(_split, routes)
        summed = tally(again).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        found = tally(dealt.join(large, "shard", "left_anti")).unionByName(summed)
    found = materialize(found, "phrase-counts")
    release(dealt)
    return found.unionByName(often.filter("word is not null").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")), totals


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, report: int = REPORT, shard_rows: int = SHARD_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``report`` phrases of every language.

    Words and phrases of two to LONGEST words are counted within pieces of the lower-cased texts, in each
    language (null: ``und``) by itself. Null and empty texts hold none; repeated rows count again; texts of
    any length are read whole, in slices; other columns are ignored; no rows, or none often enough, give
    no rows. Ties in score go by count, then by phrase in byte order.
    """
    found, totals = counts(docs, least, shard_rows, split_rows)
    candidates = found.filter("words > 1").withColumnRenamed("n", "a")
    held = F.split("phrase", " ")
    cut = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    joined = lambda start, n: F.array_join(F.slice(held, start, n), " ")
    cut = cut.withColumns({"left": joined(F.lit(1), F.col("k")), "right": joined(F.col("k") + 1, F.col("words") - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(found.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    score = F.expr(f"cast({SCALE} as decimal(8,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Every shorter phrase within a candidate learns of the most frequent one around it.
    inner = candidates.filter("words > 2").select("lang", "a", held.alias("w"), F.col("words").alias("of"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("of") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("around"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.expr(f"around is null or cast(100 as decimal(3,0)) * cast(around as decimal(19,0)) < cast({covered} as decimal(3,0)) * cast(a as decimal(19,0))"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", place.cast("long")).filter(F.col("rank") <= report)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", F.col("total").alias("n"), "best.score")


def _oracle() -> str:
    """The same in DuckDB, counting every phrase."""
    return f"""
    WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
    q AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
    s AS (SELECT lang, w, i, unnest(range(1, least({LONGEST}, len(w) - i + 1) + 1)) AS words FROM q),
    f AS (SELECT lang, array_to_string(w[i:i + words - 1], ' ') AS phrase, words, count(*) AS n FROM s GROUP BY ALL),
    t AS (SELECT lang, sum(n)::BIGINT AS total FROM f WHERE words = 1 GROUP BY lang),
    c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, words, n AS a FROM f WHERE words > 1 AND n >= {LEAST}),
    k AS (SELECT *, unnest(range(1, words)) AS k FROM c),
    cut AS (SELECT k.lang, k.phrase, k.a, k.k, x.n AS l, y.n AS r, (({SCALE}::HUGEINT * k.a) // (x.n + y.n))::BIGINT AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k.k + 1:k.words], ' ')),
    best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    m AS (SELECT *, unnest(range(2, words)) AS size FROM c),
    o AS (SELECT *, unnest(range(1, words - size + 2)) AS spot FROM m),
    inside AS (SELECT lang, array_to_string(w[spot:spot + size - 1], ' ') AS phrase, max(a) AS around FROM o GROUP BY ALL),
    kept AS (SELECT best.* FROM best LEFT JOIN inside i ON i.lang = best.lang AND i.phrase = best.phrase WHERE i.around IS NULL OR 100::HUGEINT * i.around < {COVERED}::HUGEINT * best.a)
    SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total AS n, score FROM kept JOIN t ON t.lang = kept.lang QUALIFY rank <= {REPORT}"""


ORACLE = _oracle()
