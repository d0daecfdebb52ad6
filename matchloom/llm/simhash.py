"""Near-duplicate documents by 64-bit SimHash and pigeonring filtering.

A fingerprint is cut into ``segments`` equal parts on a ring. If two fingerprints differ in at most
``distance`` bits, then from some start every chain of the next l segments differs in at most
``l * distance / segments`` bits. The chains whose budget is zero give the join key; the longer
budgets prune pairs inside a key before the full Hamming check.
"""

from __future__ import annotations

from functools import partial
from itertools import islice, repeat
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import connected_components, materialize, roots, utf8

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
CHUNK_WORDS = 100_000
PAIR_RUN = 32
BLOCK = 2048


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a UTF-8 text; 0 without words."""
    found = iter(text.lower().split()) if len(text) < 4 << 20 else (m[0].lower() for m in _WORDS.finditer(text))
    ones, total, carry = np.zeros(64, dtype=np.int64), 0, []
    while part := list(islice(found, CHUNK_WORDS)):
        part = carry + part
        if len(part) >= words:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(words))))
            h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
        carry = part[-(words - 1) :] if words > 1 else []
    if not total:
        if not carry:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(carry), seed)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(words, batches):
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        fps = [fingerprint(bytes(data[a:b]), words) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.record_batch([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null texts are empty."""
    return docs.select("doc_id", "text").mapInArrow(partial(_fingerprints, words), "doc_id long, fp long")


def budgets(distance: int, segments: int) -> list[tuple[int, int]]:
    """(bits from the start of a chain, differing bits allowed there), where a budget ends."""
    width = 64 // segments
    allowed = [l * distance // segments for l in range(1, segments + 1)]
    return [(width * l, allowed[l - 1]) for l in range(1, segments + 1) if l == segments or allowed[l] > allowed[l - 1]]


def _keep(limits, diff: np.ndarray) -> np.ndarray:
    """Which XORs of rotated fingerprints stay within all chain budgets; the last is the Hamming check."""
    ok = np.ones(diff.shape, dtype=bool)
    for bits, most in limits[1:]:
        ok &= np.bitwise_count(diff >> np.uint64(64 - bits)) <= most
    return ok


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return start, np.diff(np.r_[start, len(key)])


def _short_runs(limits, x, run_of):
    """Links between members of the same short run, by offset within the sorted array."""
    a, b = [], []
    for d in range(1, PAIR_RUN):
        i = np.flatnonzero(run_of[d:] == run_of[:-d])
        if not len(i):
            break
        i = i[_keep(limits, x[i] ^ x[i + d])]
        a.append(i)
        b.append(i + d)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, int),) * 2


def _long_run(limits, x: np.ndarray) -> np.ndarray:
    """Labels for a long run: the next chain allows one differing bit, so blank each bit in turn."""
    n, label = len(x), np.arange(len(x))
    (bits, _), (longer, most) = limits[0], limits[1]
    shifts = range(64 - longer, 64 - bits) if most == 1 else [None]
    for s in shifts:
        key = (x >> np.uint64(64 - longer)) & ~np.uint64(1 << (s - (64 - longer))) if s is not None else np.zeros(n, np.uint64)
        order = np.argsort(key, kind="stable")
        start, size = _runs(key[order])
        run_of = np.repeat(np.arange(len(start)), size)
        short = np.repeat(size <= PAIR_RUN, size)
        if short.any():
            at = order[short]
            i, j = _short_runs(limits, x[at], run_of[short])
            label = _merge(label, at[i], at[j])
        for k in np.flatnonzero(size > PAIR_RUN):
            at = order[start[k] : start[k] + size[k]]
            for p in range(0, len(at), BLOCK):
                for q in range(p, len(at), BLOCK):
                    i, j = np.nonzero(_keep(limits, x[at[p : p + BLOCK], None] ^ x[None, at[q : q + BLOCK]]))
                    label = _merge(label, at[p + i], at[q + j])
    return label


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after more links; label[i] <= i is the smallest known index linked with i."""
    differ = label[a] != label[b]
    if not differ.any():
        return label
    return roots(len(label), label[a[differ]], label[b[differ]])[label]


def _link(limits, batches):
    """Spanning links inside each key of a partition sorted by key; a key may span batches."""

    def solve(key, x, rep):
        start, size = _runs(key)
        run_of = np.repeat(np.arange(len(start)), size)
        short = np.repeat(size <= PAIR_RUN, size)
        at = np.flatnonzero(short)
        i, j = _short_runs(limits, x[at], run_of[at])
        label = roots(len(x), at[i], at[j])
        for k in np.flatnonzero(size > PAIR_RUN):
            s, e = start[k], start[k] + size[k]
            label[s:e] = s + _long_run(limits, x[s:e])
        own = np.flatnonzero(label != np.arange(len(x)))
        return pa.record_batch([pa.array(rep[own]), pa.array(rep[label[own]])], names=["a", "b"])

    held = [], [], []
    rows = 0
    for batch in batches:
        key, x, rep = (np.asarray(batch.column(i)) for i in range(3))
        if not len(key):
            continue
        for store, part in zip(held, (key, x.view(np.uint64), rep)):
            store.append(part)
        rows += len(key)
        if rows < 500_000 or key[0] == key[-1]:
            continue
        key, x, rep = (np.concatenate(s) for s in held)
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if cut:
            yield solve(key[:cut], x[:cut], rep[:cut])
        held = [key[cut:]], [x[cut:]], [rep[cut:]]
        rows = len(key) - cut
    if rows:
        yield solve(*(np.concatenate(s) for s in held))


def near_links(prints: DataFrame, distance: int = 3, segments: int = 16) -> DataFrame:
    """(a, b): spanning links between the ``rep`` values of fingerprints (fp, rep), fp distinct.

    Two rows are connected in the result exactly if a chain of pairs at ``distance`` bits or fewer
    connects them. Within one key a spanning forest is returned, never all pairs.
    """
    limits = budgets(distance, segments)
    width, bits = 64 // segments, limits[0][0]
    turns = F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))
    turned = prints.withColumn("turn", turns).withColumn("x", F.expr(f"(fp << (turn * {width})) | shiftrightunsigned(fp, 64 - turn * {width})"))
    keyed = turned.select(F.expr(f"(cast(turn as long) << {bits}) | shiftrightunsigned(x, {64 - bits})").alias("key"), "x", "rep")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_link, limits), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, segments: int = 16) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``.

    component_id is the smallest doc_id reachable by links of ``distance`` bits or fewer. Equal
    fingerprints collapse before the search, so copies cost nothing. Null texts count as empty; rows
    with a null doc_id link with nothing and get a null component_id. A repeated doc_id joins the
    groups of its rows. Extra columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, words), "simhash-prints")
    own = materialize(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    again = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi")
    repeated = prints.join(again.select("doc_id"), "doc_id", "left_semi").join(own, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = near_links(own.select("fp", "rep"), distance, segments).unionByName(repeated)
    found = connected_components(links, "simhash-links")
    named = own.join(found, own.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    joined = prints.join(named, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
