"""Removal of long repeated byte strings by suffix arrays.

Every window of ``length`` bytes has one anchor, the smallest hash of its short substrings, so that
equal windows have equal anchors wherever they stand. Runs of windows with one anchor form segments.
Segments whose anchor occurs again meet in shards of bounded size. There a suffix array is refined by
the method of Larsson and Sadakane, Kasai's common prefixes show the windows that occur again, and an
anchor with too many segments for one shard has them cut into pieces first, which meet only if what all
windows of a piece have in common occurs again. If that is still too much for one shard it is spread over several, whose different windows are merged by
binary search among their 128-bit hashes. Texts never meet as a whole; equal segments travel once, with their number.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, small_batches, utf8

LENGTH = 400
GRAM = 64
SHARD_BYTES = 3 << 19
#: Pieces that the segments of an anchor with more text than a shard are cut into.
PIECES = 22
CHUNK = 1 << 22
_ODD = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, size=256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


_BACK = pow(_ODD, -1, 1 << 64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``gram`` bytes from every position."""
    n = len(data) - gram + 1
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * _powers(_BACK, len(data)), out=total[1:])
    h = (total[gram:] - total[:-gram]) * _powers(_ODD, n)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by blocks (van Herk)."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(number of the text, first window, number of windows, anchor hash) of all segments of texts
    that lie at [starts, ends) in ``data``; windows are counted from the start of ``data``."""
    if len(data) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = gram_hashes(data, gram)
    low = np.uint64((1 << 23) - 1)
    anchor = (sliding_minimum((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    count = np.maximum(ends - starts - length + 1, 0)
    owner = np.repeat(np.arange(len(starts)), count)
    at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    anchor = anchor[at]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    return owner[first], at[first], np.diff(np.r_[first, len(at)]), h[anchor[first]]


def _chunks(offsets: np.ndarray, length: int):
    """Groups of whole texts, or parts of a very long text that overlap by a window less one byte:
    (first text, offsets of the texts, position of the part in its text)."""
    k, n = 0, len(offsets) - 1
    while k < n:
        a, b = int(offsets[k]), int(offsets[k + 1])
        if b - a > CHUNK:
            for p in range(a, b - length + 1, CHUNK - length + 1):
                yield k, np.array([p, min(p + CHUNK, b)]), p - a
            k += 1
            continue
        e = max(k + 1, int(np.searchsorted(offsets, a + CHUNK, side="right")) - 1)
        yield k, offsets[k : e + 1], 0
        k = e


def _segment_rows(length, gram, batches):
    for batch in small_batches(batches):
        offsets, raw = utf8(batch.column(2))
        bytes_ = np.frombuffer(raw, dtype=np.uint8)
        for k, cut, skip in _chunks(offsets, length):
            base = int(cut[0])
            owner, at, count, anchor = segments(bytes_[base : int(cut[-1])], cut[:-1] - base, cut[1:] - base, length, gram)
            if not len(owner):
                continue
            part = raw[base : int(cut[-1])]
            seg = np.fromiter((xxhash.xxh3_64_intdigest(part[s:e]) for s, e in zip(at.tolist(), (at + count + length - 1).tolist())), dtype=np.uint64, count=len(at))
            rows = k + owner
            place = at - (cut[owner] - base) + skip
            # A periodic text has one segment many times: it travels once, with its places.
            order = np.lexsort((place, seg, anchor, rows))
            key = np.stack([rows[order], anchor[order].view(np.int64), seg[order].view(np.int64)])
            first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)], pa.int32()), pa.array(place[order]))
            row = pa.array(key[0, first])
            yield pa.record_batch(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(key[1, first]), pa.array(key[2, first]), places, pa.array(count[order][first].astype(np.int32))],
                names=["doc", "print", "anchor", "seg", "places", "windows"],
            )


def suffix_order(data: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes at least, equal ones by position; ``left`` is the
    length of each.

    Groups of suffixes that agree so far are refined by the ranks of what follows (Larsson and
    Sadakane), which doubles the depth; single suffixes and ended ones aren't touched again.
    """
    n, h = len(data), 7
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(1,)).astype(np.uint64).byteswap()
    used = np.minimum(left, h).astype(np.uint64)
    key = (words >> np.uint64(8)) >> (np.uint64(8) * (np.uint64(h) - used)) << (np.uint64(8) * (np.uint64(h) - used)) << np.uint64(8) | used
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, dtype=np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, n])
    rank[order] = np.repeat(first, size)
    places = np.flatnonzero(np.repeat(size > 1, size))
    ended = []
    while len(places) and h < depth:
        i = order[places]
        nxt = np.where(left[i] > h, rank[np.minimum(i + h, n - 1)] + 1, 0)
        key = rank[i] << 32 | nxt
        by = np.argsort(key)
        i, key = i[by], key[by]
        order[places] = i
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        rank[i] = np.repeat(places[first], size)
        many, on = np.repeat(size > 1, size), key & 0xFFFFFFFF > 0
        ended.append(places[many & ~on])
        places = places[many & on]
        h *= 2
    equal = np.concatenate([*ended, places])
    if len(equal):
        equal.sort()
        i = order[equal]
        order[equal] = i[np.argsort(rank[i] << 32 | i)]
    return order


def repeats_ahead(data: np.ndarray, left: np.ndarray, before: np.ndarray, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """For each window whether it shares ``length`` bytes with its predecessor in the suffix array.

    Kasai's scan: the common prefix of the next suffix is shorter by one at most. All segments are
    scanned side by side, eight bytes at a time.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
    out = np.zeros(len(data), dtype=bool)
    order = np.argsort(-count, kind="stable")
    start, count = start[order], count[order]
    common = np.zeros(len(start), dtype=np.int64)
    for t in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -t, side="left"))
        i = start[:live] + t
        j = before[i]
        some = j >= 0
        most = np.where(some, np.minimum(length, left[np.maximum(j, 0)]), 0)
        c = np.minimum(np.maximum(common[:live] - 1, 0), most)
        go = np.flatnonzero(c < most)
        while len(go):
            x = words[i[go] + c[go]] ^ words[j[go] + c[go]]
            same = np.where(x == 0, 8, np.bitwise_count((x & -x) - np.uint64(1)) >> 3)
            c[go] = np.minimum(c[go] + same, most[go])
            go = go[(x == 0) & (c[go] < most[go])]
        common[:live] = c
        out[i] = c >= length
    return out


def shard_repeats(texts: pa.Array, copies: np.ndarray, length: int):
    """For the segments of one shard: (segment, window, class, weight of the class) of every window,
    by class; windows of one class are equal, the weight counts copies."""
    offsets, raw = utf8(texts)
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]
    start = offsets[:-1] - offsets[0]
    size = np.diff(offsets)
    seg = np.repeat(np.arange(len(size)), size)
    left = np.repeat(start + size, size) - np.arange(len(data))
    order = suffix_order(data, left, int(size.max()))
    before = np.empty(len(data), dtype=np.int64)
    before[order] = np.r_[-1, order[:-1]]
    same = repeats_ahead(data, left, before, start, size - length + 1, length)
    order = order[left[order] >= length]
    group = np.cumsum(~same[order]) - 1
    weight = np.bincount(group, weights=copies[seg[order]]).astype(np.int64)
    return seg[order], order - start[seg[order]], group, weight[group]


_FOUND = "anchor long, seg long, since int, until int, high long, low long"


def _found(anchor, seg, since, until, high=None, low=None) -> pa.Table:
    n = len(since)
    full = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.table([pa.array(anchor, pa.int64()), pa.array(seg, pa.int64()), pa.array(since, pa.int32()), pa.array(until, pa.int32()), full(high), full(low)], names=["anchor", "seg", "since", "until", "high", "low"])


def _shard(length, table: pa.Table) -> pa.Table:
    """Rows of repeated windows [since, until) of each segment and, for a shard that holds part of an
    anchor, one row with its 128-bit hash for every different window."""
    table = table.combine_chunks()
    anchor, seg = (np.asarray(table.column(c)) for c in ("anchor", "seg"))
    text = table.column("bytes").combine_chunks()
    s, w, group, weight = shard_repeats(text, np.asarray(table.column("copies")), length)
    again = weight > 1
    by = np.lexsort((w[again], s[again]))
    rs, rw = s[again][by], w[again][by]
    first = np.flatnonzero(np.r_[True, (rs[1:] != rs[:-1]) | (rw[1:] != rw[:-1] + 1)]) if len(rs) else np.empty(0, int)
    last = np.r_[first[1:], len(rs)] - 1 if len(rs) else first
    out = _found(anchor[rs[first]], seg[rs[first]], rw[first], rw[last] + 1)
    if not table.column("part")[0].as_py():
        return out
    one = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    offsets, raw = utf8(text)
    at = (offsets[s[one]] + w[one]).tolist()
    keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a : a + length]) for a in at), dtype=">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
    since, until = w[one], np.where(weight[one] > 1, w[one], w[one] + 1)
    return pa.concat_tables([out, _found(anchor[s[one]], seg[s[one]], since, until, keys[:, 0], keys[:, 1])])


def _merge(table: pa.Table) -> pa.Table:
    """Windows that two shards hold, told by their 128-bit hashes: a shard names a window once, so one that
    binary search finds twice in the merged order is in another shard. Windows that repeat inside their shard (since =
    until) only answer."""
    anchor, seg, since, until, high, low = (np.asarray(table.column(c).combine_chunks()) for c in ("anchor", "seg", "since", "until", "high", "low"))
    key = np.empty(len(high), dtype=[("high", "<i8"), ("low", "<i8")])
    key["high"], key["low"] = high, low
    _, key = np.unique(key, return_inverse=True)
    union = np.sort(key)
    hit = np.searchsorted(union, key, side="right") - np.searchsorted(union, key, side="left") > 1
    hit &= until > since
    return _found(anchor[hit], seg[hit], since[hit], until[hit])


def _pick_rows(length, batches):
    """The bytes of the segments that a document represents."""
    for batch in small_batches(batches):
        offsets, raw = utf8(batch.column(0))
        picks = batch.column(1)
        inner = picks.flatten()
        owner = np.repeat(np.arange(len(picks)), np.asarray(pa.compute.list_value_length(picks).fill_null(0)))
        x = {f.name: np.asarray(inner.field(i)) for i, f in enumerate(inner.type)}
        begin = offsets[owner] + x["place"]
        data = [raw[a:b] for a, b in zip(begin.tolist(), (begin + x["windows"] + length - 1).tolist())]
        yield pa.record_batch([pa.array(x["shard"]), pa.array(x["part"]), pa.array(x["anchor"]), pa.array(x["seg"]), pa.array(x["copies"]), pa.array([bytes(d) for d in data], pa.binary())], names=["shard", "part", "anchor", "seg", "copies", "bytes"])


def _anchors_at(data: np.ndarray, begin: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Where the anchor of each segment stands: the first smallest hash of its first window."""
    low, out = np.uint64((1 << 23) - 1), [np.empty(0, np.int64)]
    for k in range(0, len(begin), 4096):
        window = data[begin[k : k + 4096, None] + np.arange(length)]
        h = gram_hashes(window.ravel(), gram) & ~low
        out.append(np.argmin(h[np.arange(len(window))[:, None] * length + np.arange(length - gram + 1)], axis=1))
    return np.concatenate(out)


def _cut_rows(length, gram, batches):
    """The pieces of the segments that a document represents, by how far a window starts before its anchor; equal windows
    start equally far, so they lie in pieces with one core, the bytes that all windows of the piece can have in common."""
    step = -(-(length - gram + 1) // PIECES)
    for batch in small_batches(batches):
        offsets, raw = utf8(batch.column(2))
        picks = batch.column(3)
        inner = picks.flatten()
        owner = np.repeat(np.arange(len(picks)), np.asarray(pa.compute.list_value_length(picks).fill_null(0)))
        x = {f.name: np.asarray(inner.field(i)) for i, f in enumerate(inner.type)}
        begin = offsets[owner] + x["place"]
        at = _anchors_at(np.frombuffer(raw, dtype=np.uint8), begin, length, gram)
        most, least = at // step, (at - x["windows"] + 1) // step
        row = np.repeat(np.arange(len(at)), most - least + 1)
        piece = most[row] - (np.arange(len(row)) - np.repeat(np.cumsum(most - least + 1) - (most - least + 1), most - least + 1))
        near, far = piece * step, np.minimum(piece * step + step - 1, length - gram)
        since = np.maximum(at[row] - far, 0)
        until = np.minimum(at[row] - near + 1, x["windows"][row])
        core = zip((begin[row] + at[row] - near).tolist(), (begin[row] + at[row] - far + length).tolist(), piece.tolist())
        text = zip((begin[row] + since).tolist(), (begin[row] + until - 1 + length).tolist())
        signed = lambda hashes: pa.array(np.fromiter(hashes, dtype=np.uint64, count=len(row)).view(np.int64))
        yield pa.record_batch(
            [
                *(batch.column(i).take(pa.array(owner[row])) for i in (0, 1)),
                *(pa.array(x[c][row]) for c in ("anchor", "seg", "copies")),
                *(pa.array(v.astype(t)) for v, t in ((x["place"][row] + since, np.int64), (since, np.int32), (until - since, np.int32))),
                signed(xxhash.xxh3_64_intdigest(raw[a:b], seed=n + 1) for a, b, n in core),
                signed(xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in text),
            ],
            names=["doc", "print", "anchor", "seg", "copies", "place", "since", "windows", "core", "piece"],
        )


def _with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc"), F.xxhash64(text).alias("print"), text.cast("binary").alias("text"))


_CUT = "doc long, print long, anchor long, seg long, copies long, place long, since int, windows int, core long, piece long"


def _again(segs: DataFrame, length: int) -> DataFrame:
    """(anchor, bytes) of the anchors that occur more than once, with all text of their different segments."""
    return segs.groupBy("anchor").agg(F.sum("copies").alias("total"), F.sum(F.col("one.windows") + (length - 1)).alias("bytes")).filter("total > 1").select("anchor", "bytes")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc, print, spans: byte ranges covered by a ``length``-byte string that also starts anywhere
    else, of each text (known by doc_id and hash) that has any; ranges may overlap."""
    keyed = _with_key(docs)
    found = materialize(keyed.select("doc", "print", "text").mapInArrow(partial(_segment_rows, length, gram), "doc long, print long, anchor long, seg long, places array<long>, windows int"), "repeat-segments")
    segs = found.groupBy("anchor", "seg").agg(F.sum(F.size("places")).alias("copies"), F.min(F.struct("doc", "print", F.get("places", F.lit(0)).alias("place"), "windows")).alias("one"))
    shared = materialize(segs.join(_again(segs, length), "anchor").select("anchor", "seg", "copies", "one.*", "bytes"), "repeat-shared")
    cut = None
    if not (large := shared.filter(F.col("bytes") > shard_bytes)).isEmpty():
        picks = large.groupBy("doc", "print").agg(F.collect_list(F.struct("place", "windows", "anchor", "seg", "copies")).alias("picks"))
        pieces = keyed.join(picks, ["doc", "print"]).select("doc", "print", "text", "picks").mapInArrow(partial(_cut_rows, length, gram), _CUT)
        # Rows with the same doc_id and text bring their segments twice; a piece counts once.
        cut = materialize(pieces.dropDuplicates(["anchor", "seg", "since"]), "repeat-cut")
        segs = cut.groupBy(F.col("core").alias("anchor"), F.col("piece").alias("seg")).agg(F.sum("copies").alias("copies"), F.min(F.struct("doc", "print", "place", "windows")).alias("one"))
        again = materialize(_again(segs, length), "repeat-cores")
        finer = segs.join(again, "anchor").select("anchor", "seg", "copies", "one.*", "bytes")
        shared = materialize(shared.filter(F.col("bytes") <= shard_bytes).unionByName(finer), "repeat-shared")
    volume = shared.agg(F.sum(F.col("windows") + (length - 1))).first()[0] or 0
    shards = max(1, -(-volume // shard_bytes))
    part = F.col("bytes") > shard_bytes
    shard = F.when(part, F.xxhash64("anchor", F.pmod("seg", F.ceil(F.col("bytes") / shard_bytes)))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    pick = F.struct("place", "windows", "anchor", "seg", "copies", part.alias("part"), shard.alias("shard"))
    picks = shared.groupBy("doc", "print").agg(F.collect_list(pick).alias("picks"))
    # Rows with the same doc_id and text bring their segments twice; those count twice anyway.
    texts = keyed.join(picks, ["doc", "print"])
    pieces = texts.select("text", "picks").mapInArrow(partial(_pick_rows, length), "shard long, part boolean, anchor long, seg long, copies long, bytes binary")
    local = materialize(pieces.groupBy("shard").applyInArrow(lambda table: _shard(length, table), _FOUND), "repeat-local")
    whole = local.filter("high is null")
    split = local.filter("high is not null").withColumn("range", F.shiftrightunsigned("high", max(24, 60 - int(volume // shard_bytes).bit_length())))
    across = split.groupBy("range").applyInArrow(lambda table: _merge(table), _FOUND)
    # Written first, so that both sides of the join are plain exchanges and a hot segment can be split.
    windows = materialize(whole.unionByName(across).groupBy("anchor", "seg").agg(F.collect_set(F.struct("since", "until")).alias("runs")), "repeat-windows")
    if cut is not None:
        runs = cut.join(windows, (F.col("core") == windows.anchor) & (F.col("piece") == windows.seg)).select(cut.anchor, cut.seg, "since", F.explode("runs").alias("run"))
        moved = F.struct((F.col("since") + F.col("run.since")).alias("since"), (F.col("since") + F.col("run.until")).alias("until"))
        windows = materialize(windows.unionByName(runs.groupBy("anchor", "seg").agg(F.collect_set(moved).alias("runs"))), "repeat-windows")
    spans = found.select("doc", "print", "anchor", "seg", "places").join(windows, ["anchor", "seg"])
    moved = F.flatten(F.transform("places", lambda p: F.transform("runs", lambda r: F.struct((p + r.since).alias("since"), (p + r.until + (length - 1)).alias("until")))))
    # Rows with the same doc_id and text bring the same runs; a set keeps them once.
    return spans.select("doc", "print", moved.alias("runs")).groupBy("doc", "print").agg(F.flatten(F.collect_set("runs")).alias("spans"))


def _kept_rows(batches):
    for batch in small_batches(batches):
        offsets, raw = utf8(batch.column(1))
        spans = batch.column(2)
        out = []
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            text, kept, at, runs = raw[a:b], [], 0, 0
            if spans[k].is_valid:
                inner = spans[k].values
                since, until = np.asarray(inner.field(0)), np.asarray(inner.field(1))
                by = np.argsort(since, kind="stable")
                since, until = since[by], np.maximum.accumulate(until[by])
                head = np.flatnonzero(np.r_[True, since[1:] > until[:-1]])
                for s, e in zip(since[head].tolist(), until[np.r_[head[1:], len(since)] - 1].tolist()):
                    kept.append(text[at:s])
                    at, runs = e, runs + 1
            kept.append(text[at:])
            out.append((len(text), runs, b"".join(kept)))
        yield pa.record_batch(
            [batch.column(0), pa.array([n for n, _, _ in out], pa.int64()), pa.array([n - len(k) for n, _, k in out], pa.int64()), pa.array([r for _, r, _ in out], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for _, _, k in out], pa.string()), pa.array([k for _, _, k in out], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) for every row of ``docs``.

    A byte goes if a ``length``-byte string of the input covers it that also starts anywhere else, in
    the same text or another; two rows with one text repeat each other. Null texts are empty; texts
    shorter than ``length`` stay; rows with a null doc_id are treated like any other. Extra columns are
    ignored; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, length, **how)
    joined = _with_key(docs).join(spans, ["doc", "print"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_kept_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
